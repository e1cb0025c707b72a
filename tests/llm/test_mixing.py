from driftline.llm import mixing

DOCS = "doc_id bigint, source string, n_tokens bigint"
SPECS = "mix_id string, source string, target_share double, max_repeat int, corpus_fraction double"


def run(spark, docs, specs, **kw):
    sized = spark.createDataFrame(docs, DOCS)
    rated = mixing.rates(mixing.source_tokens(sized), spark.createDataFrame(specs, SPECS))
    mixed = mixing.mix(sized, rated, **kw)
    return mixed, {(r.mix_id, r.source): r for r in mixing.share_report(mixed, rated).collect()}


def test_shares_and_caps(spark):
    docs = [(i, "big" if i % 10 else "small", 100) for i in range(4000)] + [(9000, None, 50)]
    specs = [("m", "big", 0.5, 4, 0.5), ("m", "small", 0.3, 2, 0.5), ("m", "absent", 0.2, 9, 0.5)]
    mixed, report = run(spark, docs, specs)
    total = sum(d[2] for d in docs)
    big, small, absent = (report["m", s] for s in ("big", "small", "absent"))
    assert abs(big.tokens / (0.25 * total) - 1) < 0.1 and big.most_copies == 1
    assert small.rate == 1.5 or abs(small.rate - 0.15 * total / 40_000) < 1e-9
    assert abs(small.tokens / (0.15 * total) - 1) < 0.1 and small.most_copies == 2
    assert (absent.tokens, absent.source_tokens, absent.reached_share) == (0, 0, 0.0)
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9
    copies = mixed.groupBy("mix_id", "doc_id").count().agg({"count": "max"}).first()[0]
    assert copies <= 2
    capped = run(spark, docs, [("m", "small", 1.0, 2, 1.0)])[1]["m", "small"]
    assert capped.tokens == 2 * capped.source_tokens


def test_same_on_every_run_and_partitioning(spark):
    docs = [(i, "a", 10) for i in range(500)]
    specs = [("m", "a", 1.0, 3, 0.37), ("n", "a", 1.0, 3, 0.37)]
    one = sorted(map(tuple, run(spark, docs, specs)[0].collect()))
    two = sorted(map(tuple, run(spark, docs[::-1], specs)[0].repartition(7).collect()))
    assert one == two
    assert {r[2] for r in one if r[0] == "m"} != {r[2] for r in one if r[0] == "n"}
    assert one != sorted(map(tuple, run(spark, docs, specs, seed=3)[0].collect()))


def test_edges(spark):
    mixed, report = run(spark, [], [("m", "a", 1.0, 3, 0.5)])
    assert mixed.collect() == [] and report["m", "a"].reached_share == 0.0
    mixed, report = run(spark, [(1, "a", 0), (2, "a", 0)], [("m", "a", 1.0, 3, 0.5)])
    assert mixed.collect() == [] and report["m", "a"].tokens == 0
    assert run(spark, [(1, "a", 5)], [])[1] == {}
    nulls = run(spark, [(1, "a", 5)], [("m", "a", None, None, None), (None, None, 1.0, 1, 1.0)])
    assert nulls[0].collect() == []


def test_source_listed_twice(spark):
    docs = [(i, "a" if i % 2 else "b", 10) for i in range(1000)]
    mixed, report = run(spark, docs, [("m", "a", 0.25, 1, 0.4), ("m", "a", 0.25, 3, 0.4), ("m", "b", 0.5, 1, 0.4)])
    a = report["m", "a"]
    assert (a.target_share, a.max_repeat, len(report)) == (0.5, 3, 2)
    assert a.tokens == sum(r.n_tokens for r in mixed.where("source = 'a'").collect()) and abs(a.reached_share - 0.5) < 0.1
