import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import garbled


@pytest.mark.parametrize("name", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "utf-8>cp850", "mac_roman>cp1252", "cp1252>mac_roman", "cp850>cp1252"])
def test_round_trip(name):
    text = "Größe fällt über Straße – já não é só «così» señor"
    right, wrong = name.split(">")
    table = {b: c for c, b in garbled._bytes_of(wrong).items()}
    clean = "".join(c for c in text if c.isascii() or c.encode(right, "ignore"))
    spoilt = "".join(table.get(b, chr(b)) for b in clean.encode(right))
    restored, n = garbled.undo(spoilt, name)
    assert restored == clean
    assert n >= sum(not c.isascii() for c in clean) - 1


def test_double_and_cyrillic():
    twice = "über".encode().decode("cp1252").encode().decode("cp1252")
    assert garbled.undo(twice, "utf-8>cp1252>utf-8>cp1252") == ("über", 1)
    assert garbled.undo("город".encode().decode("cp1251"), "utf-8>cp1251") == ("город", 5)
    assert garbled.undo("город".encode("koi8-r").decode("cp1251"), "koi8-r>cp1251") == ("город", 5)


def test_clean_text_stays():
    for text in ("ÇÃO SÃO «é» à", "naïve café", "Äpfel, Ö", "город — «дом»", "", "plain"):
        for t in garbled.transformations():
            if t.startswith("utf-8"):
                assert garbled.undo(text, t)[1] <= 1, (text, t)


def test_alignment():
    assert garbled.aligned_runs("fÃ¼r GrÃ¶ÃŸe", "für Größe") == [("Ã¼", "ü"), ("Ã¶ÃŸ", "öß")]
    assert "utf-8>cp1252" in garbled.explained_by("fÃ¼r GrÃ¶ÃŸe", "für Größe")
    assert garbled.explained_by("für", "fär") == []


WORDS = ["größer", "fällt", "über", "straße", "schön", "möglich", "früh", "täglich", "müssen", "höher", "länger", "grüße", "wärme", "kälte", "süß", "öfter"]


def corpus(seed=1):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice(WORDS + ["und", "die", "haus"]) for _ in range(30)) + "\ndie tägliche größere Zeitung der Stadt") for i in range(120)]
    bad = set(rng.sample(range(120), 12))
    out = []
    for i, t in docs:
        if i in bad:
            t = t.encode().decode("cp1252", "replace") if i % 2 else "".join(c if c.isascii() else chr(0) for c in t).replace("\0", "�")
        out.append((i, t))
    return out, bad, dict(docs)


def test_corpus(spark):
    rows, bad, clean = corpus()
    rows += [(500, None), (501, ""), (502, "SPECIMEN — Â À Å Ñ ß ¿"), (503, "Fi§ch Da§ i†t e¢ht"), (504, "gr��er"), (505, "x " * 400_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("clash"), "transformation": F.lit(1)})
    found = garbled.garbled_documents(df)
    got = {r.doc_id: r.transformation for r in found.collect()}
    assert set(got) == bad
    restored = {r.doc_id: r.restored for r in garbled.restored_documents(df, found).collect()}
    for i in bad:
        if i % 2:
            assert got[i] == "utf-8>cp1252" and restored[i] == clean[i]
        else:
            assert got[i] is None and restored[i] is None


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert garbled.garbled_documents(df).collect() == []


def swap(text, right="cp1252", wrong="mac_roman"):
    return text.encode(right).decode(wrong)


def test_third_of_rows_garbled(spark):
    """A third of all texts garbled by one byte swap: right words have but twice as many documents."""
    rng = random.Random(3)
    clean = {i: " ".join(rng.choice(WORDS) for _ in range(12)) + f" {i}" for i in range(90)}
    bad = set(range(0, 90, 3))
    rows = [(i, swap(t) if i in bad else t) for i, t in clean.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = garbled.garbled_documents(df)
    assert {r.doc_id for r in found.collect()} == bad
    restored = {r.doc_id: r.restored for r in garbled.restored_documents(df, found).collect()}
    assert restored == {i: clean[i] for i in bad}


def test_copies_count_once(spark):
    rng = random.Random(4)
    clean = {i: " ".join(rng.choice(WORDS) for _ in range(12)) + f" {i}" for i in range(60)}
    bad = set(range(100, 160))
    copied = " ".join(WORDS)
    rows = list(clean.items()) + [(i, swap(copied)) for i in bad]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in garbled.garbled_documents(df).collect()} == bad


def test_only_stretches_restored(spark):
    """Clean letters beside a stretch stay, and a second stretch of another transformation is undone too."""
    rng = random.Random(5)
    clean = {i: "\n".join(" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(6)) for i in range(60)}
    rows = []
    for i, t in clean.items():
        x = t.split("\n")
        if i < 6:
            x[1], x[4] = swap(x[1]), x[4].encode().decode("cp1252", "replace") if i % 2 else x[4]
        rows.append((i, "\n".join(x)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = garbled.garbled_documents(df)
    restored = {r.doc_id: r.restored for r in garbled.restored_documents(df, found).collect()}
    assert restored == {i: clean[i] for i in range(6)}


def test_stretch_repair():
    known = {swap("größer"): "größer"}
    dirty = "clean café — über\n" + swap("größer „kufögung“ süß") + "\nclean café — über"
    assert garbled.repair(dirty, "cp1252>mac_roman", known, {"šö"}) == ("clean café — über\ngrößer „kufögung“ süß\nclean café — über", 7)


def test_words_and_lines_with_other_characters(spark):
    """Exactly the words and lines that hold non-ASCII characters, as Python finds them."""
    import re

    rng = random.Random(6)
    texts = ["".join(rng.choice("ab Z9é§-_'\t\n\x0b\x1c\x7f\x85 ’дя�😀.") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "plain\nascii"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in garbled.spoilable_lines(df, F.col("text")).collect()}
    for i, t in enumerate(texts):
        if t.isascii():
            assert i not in got
            continue
        assert [x.line for x in got[i].lines] == [x for x in t.split("\n") if not x.isascii()]
        assert got[i].words == [w for w in re.findall(garbled.WORD, "\n".join(x for x in t.split("\n") if not x.isascii()), re.ASCII) if not w.isascii()]
        assert got[i].lost == t.count("�")
        keyed = [len(re.findall("[A-Za-z]", x.line)) >= garbled.TWIN_LETTERS for x in got[i].lines]
        assert keyed == [x.key is not None for x in got[i].lines]
