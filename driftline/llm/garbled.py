"""Texts that were decoded with a wrong character encoding.

1. Near-twins are texts that are equal once their non-ASCII characters are
   stripped: lines, and words.  A garbled text and its right form always are,
   as every encoding spoils non-ASCII characters only.
   The variant most documents have stands for the text; the others are aligned
   with it character by character, and what some wrong reading explains (bytes
   of one encoding read as another) is evidence for that transformation and a
   mapping of the word.  Words without a near-twin are not looked at.
2. Which way a transformation goes is judged by all its words together, for
   each character it changes, so common garbled words count as well; equal
   texts count once.
3. Stripping leaves nothing of words in Cyrillic and of very short ones.  They
   are twins if a transformation turns one into the other.
4. Transformations with enough evidence are accepted; their word mappings are
   applied to all documents, and characters spoilt are counted per document
   and transformation.  UTF-8 sequences of three and more characters that turn
   up in no clean text count under an accepted transformation too, and so do
   replacement characters.
5. Texts are restored by word mappings and, for byte swaps, on the lines that
   hold such words and those beside them; clean words and all other text stay.

Documents are scanned once; all else works on their lines with non-ASCII
characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import cut, shuffle_partitions

WORD = r"[^\s!-/:-@\[-`{-~]+"
BETWEEN_WORDS = r"[\s!-/:-@\[-`{-~]+"
NON_ASCII = r"[^\x00-\x7F]+"
LEAST_SPOILT = 3  # original characters
TWIN_LETTERS = 10  # ASCII letters a line must keep to have twins
WORD_LETTERS = 2  # ASCII letters a word must keep to have twins
TWIN_SUPPORT = 3  # aligned twin lines that accept a transformation
WORD_SUPPORT = 8  # distinct words that accept a transformation
SLICE = 1_000  # words restored at once; a word has up to some dozens of restorations
MORE_COMMON = 3  # times as many documents must have the restored word, or times as many words go one way as the other

# Encodings in which text is commonly kept or wrongly read, by script.
WRONG_FOR_UTF8 = ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "iso8859-2", "cp852", "cp1251", "koi8-r", "cp866"]
FAMILIES = {
    "western": ["cp1252", "mac_roman", "cp850", "cp437"],
    "central": ["cp1250", "iso8859-2", "cp852", "cp1252"],
    "cyrillic": ["cp1251", "koi8-r", "cp866"],
}
CYRILLIC_READ_AS = ["cp1252", "mac_roman"]
LATIN_READINGS = WRONG_FOR_UTF8[:8]
_SIGNS = set("—–‐“”„‘’‚«»‹›…№§¡¿ºª°£¢½¼¾×†€·©®")
# Signs that scanners put in place of letters; alone they prove no wrong encoding.
MISREAD = set("§†¢¥£½¼×¬")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def plausible(c: str) -> bool:
    o = ord(c)
    return o < 0x80 or c in _SIGNS or (c.isalpha() and (0xC0 <= o < 0x180 or 0x400 <= o < 0x460))


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte as decoders write it; bytes the encoding lacks stay as control characters."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(maxsize=None)
def _swap(wrong: str, right: str) -> dict[int, str]:
    """Table for str.translate that undoes reading ``right`` bytes as ``wrong``."""
    out = {}
    for c, b in _bytes_of(wrong).items():
        try:
            r = bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
        if r != c and plausible(r):
            out[ord(c)] = r
    return out


@lru_cache(maxsize=None)
def _sequence(wrong: str) -> re.Pattern:
    """Finds where a UTF-8 sequence read as ``wrong`` can begin."""
    lead, tail = [], []
    for c, b in _bytes_of(wrong).items():
        if 0xC2 <= b <= 0xF4:
            lead.append(re.escape(c))
        elif b < 0xC0:
            tail.append(re.escape(c))
    return re.compile(f"[{''.join(lead)}][{''.join(tail)}]")


def _unread(text: str, wrong: str) -> tuple[str, int]:
    """Undoes UTF-8 read as ``wrong`` wherever characters form whole UTF-8
    sequences of plausible characters; (text, characters restored)."""
    if not _sequence(wrong).search(text):
        return text, 0
    table = _bytes_of(wrong)
    out, n, i = [], 0, 0
    while i < len(text):
        b = table.get(text[i])
        if b is not None and 0xC2 <= b <= 0xF4:
            size = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            tail = [table.get(c) for c in text[i + 1 : i + size]]
            if len(tail) == size - 1 and None not in tail:
                seq = bytes([b, *tail])
                if _UTF8.fullmatch(seq):
                    try:
                        c = seq.decode("utf-8")
                    except UnicodeDecodeError:
                        c = ""
                    if c and (plausible(c) or c in MISREAD):
                        out.append(c)
                        n += 1
                        i += size
                        continue
        out.append(text[i])
        i += 1
    return "".join(out), n


@lru_cache(maxsize=None)
def transformations() -> list[str]:
    """At most 63, so that a set of them is a number."""
    names = [f"utf-8>{w}" for w in WRONG_FOR_UTF8] + [f"utf-8>{w}>utf-8>{w}" for w in ("cp1252", "latin-1")]
    for family in FAMILIES.values():
        names += [f"{r}>{w}" for r in family for w in family if r != w]
    names += [f"{r}>{w}" for r in FAMILIES["cyrillic"] for w in CYRILLIC_READ_AS]
    return list(dict.fromkeys(names))


def undo(text: str, name: str) -> tuple[str, int]:
    """(restored text, original characters that were spoilt) for a
    transformation ``right>wrong`` or ``utf-8>wrong>utf-8>wrong``."""
    parts = name.split(">")
    if parts[0] != "utf-8":
        table = _swap(parts[1], parts[0])
        return text.translate(table), sum(ord(c) in table for c in text)
    if len(parts) == 2:
        return _unread(text, parts[1])
    once = _undo_runs(text, parts[1])
    out, n = _unread(once, parts[1])
    return (out, n) if n else (text, 0)


def _undo_runs(text: str, wrong: str) -> str:
    """As _unread, with any characters, for the inner of two readings."""
    if not _sequence(wrong).search(text):
        return text
    table = _bytes_of(wrong)
    out, i = [], 0
    while i < len(text):
        b = table.get(text[i])
        size = 0 if b is None else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 0
        tail = [table.get(c) for c in text[i + 1 : i + size]] if size else []
        if size and len(tail) == size - 1 and None not in tail and _UTF8.fullmatch(bytes([b, *tail])):
            out.append(bytes([b, *tail]).decode("utf-8", "replace"))
            i += size
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


# ------------------------------------------------------------------ twins

_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(WORD, re.ASCII)  # as Java reads it


def aligned_runs(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Non-ASCII runs at the same places between equal ASCII characters."""

    def runs(s: str) -> dict[int, str]:
        out, gone = {}, 0
        for m in _RUN.finditer(s):
            out[m.start() - gone] = m.group()
            gone += len(m.group())
        return out

    a, b = runs(garbled), runs(clean)
    return [(a[p], b[p]) for p in a if p in b and a[p] != b[p]]


def explained_by(garbled: str, clean: str) -> list[str]:
    """Transformations that turn every differing run into its twin."""
    pairs = aligned_runs(garbled, clean)
    if not pairs or len(_RUN.findall(garbled)) != len(_RUN.findall(clean)):
        return []
    return [t for t in transformations() if all(undo(a, t)[0] == b for a, b in pairs)]


_TWIN = "ts array<string>, vote int, word string, restored string, spoilt int, strong boolean"
_TWIN_ARROW = pa.schema([("ts", pa.list_(pa.string())), ("vote", pa.int32()), ("word", pa.string()), ("restored", pa.string()), ("spoilt", pa.int32()), ("strong", pa.bool_())])


def _twin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for line, n, clean, most in zip(*[x.to_pylist() for x in b.columns]):
            forth, sure = explained_by(line, clean), int(most > n)
            out += [([t], sure, None, None, None, None) for t in forth] + [([t], -sure, None, None, None, None) for t in explained_by(clean, line)]
            if sure:
                by: dict[tuple[str, str, int], list[str]] = {}
                for t in forth:
                    for w in _WORD.findall(line):
                        r, k = undo(w, t)
                        if r != w and k and r in clean:
                            by.setdefault((w, r, k), []).append(t)
                out += [(ts, 1, w, r, k, _strong(w, r, ts[0])) for (w, r, k), ts in by.items()]
        yield _arrow(out, _TWIN_ARROW)


def spoilt_form(text: Column) -> Column:
    """Whether a text has non-ASCII characters: those take more than one byte."""
    return F.octet_length(text) > F.char_length(text)


def spoilable_lines(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, h, lines, words, lost): for each text with non-ASCII characters
    a hash, its lines with such characters (with a key of the line without
    them, null where that is too short), their words with such characters as
    often as they occur, and the number of replacement characters."""
    stripped = lambda x: F.regexp_replace(x, NON_ASCII, "")
    long = lambda x: x.rlike(f"(?:[A-Za-z][^A-Za-z]*+){{{TWIN_LETTERS}}}")
    line = lambda x: F.struct(x.alias("line"), F.when(long(x), F.xxhash64(stripped(x))).alias("key"))
    some = docs.where(spoilt_form(text)).select("doc_id", text.alias("_t"), F.filter(F.split(text, "\n", -1), spoilt_form).alias("_lines"))
    lost = F.char_length("_t") - F.char_length(F.replace("_t", F.lit("\ufffd"), F.lit("")))
    # line by line, so that a very long text makes no long array of all its words
    found = F.flatten(F.transform("_lines", lambda x: F.filter(F.split(x, BETWEEN_WORDS), spoilt_form)))
    return some.select("doc_id", F.xxhash64("_lines").alias("h"), F.transform("_lines", line).alias("lines"), found.alias("words"), lost.cast("bigint").alias("lost"))


def twin_evidence(parts: DataFrame) -> DataFrame:
    """From lines whose stripped texts are equal: rows without word, one for
    each pair of lines and transformation (vote 1 if the restored line is the
    commoner, -1 if it is the other, 0 if neither), and the words of the lines
    with vote 1."""
    lines = parts.select(F.explode("lines").alias("_l")).where("_l.key is not null")
    keyed = lines.select("_l.line", "_l.key", F.xxhash64("_l.line").alias("h"))
    # stored, so that Spark knows how few they are before lines are moved
    varied = cut(keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"))
    # count variants before gathering them; the commonest stands for the line
    variants = keyed.join(varied, "key", "left_semi").groupBy("key", "line").agg(F.count(F.lit(1)).alias("n"))
    clean = variants.groupBy("key").agg(F.max_by(F.struct(F.col("line").alias("clean"), F.col("n").alias("most")), F.struct("n", -F.length("line"), "line")).alias("_c")).select("key", "_c.*")
    pairs = variants.join(clean, "key").where("line <> clean").select("line", "n", "clean", "most")
    return pairs.mapInArrow(_twin_rows, _TWIN)


# ------------------------------------------------------------------ words


def word_types(parts: DataFrame) -> DataFrame:
    """(word, df): in how many different texts each word is; copies count
    once, in the text of the least doc_id."""
    copies = cut(parts.groupBy("h").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h", "_first"))
    once = parts.select("h", "doc_id", F.array_distinct("words").alias("words")).join(copies, "h", "left").where("_first is null or _first = doc_id")
    return once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def _long_sequences() -> str:
    """Pattern of UTF-8 sequences of three or more bytes under the readings of Latin texts."""
    found = []
    for wrong in LATIN_READINGS:
        table = _bytes_of(wrong)
        chars = lambda lo, hi: "".join(f"\\x{{{ord(c):x}}}" for c, b in table.items() if lo <= b <= hi)  # noqa: B023,E731
        found.append(f"[{chars(0xE0, 0xF4)}][{chars(0x80, 0xBF)}]{{2}}")
    return "|".join(found)


def with_twins(types: DataFrame) -> DataFrame:
    """(word, df) of the words that can have a right form: those with a
    near-twin, a word of equal stripped text that two documents hold; those of
    which stripping leaves too little to tell; and those with long sequences."""
    left = F.regexp_replace("word", NON_ASCII, "")
    keyed = types.select("word", "df", F.xxhash64(left).alias("key"), (F.length(F.regexp_replace(left, "[^A-Za-z]", "")) >= WORD_LETTERS).alias("_long"))
    shared = keyed.where("_long").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("most")).where("n > 1 and most > 1").select("key")
    twins = keyed.where("_long").join(shared, "key", "left_semi").select("word", "df")
    alone = keyed.where(~F.col("_long")).select("word", "df")
    long = types.where(F.col("word").rlike(_long_sequences())).select("word", "df")
    return twins.unionByName(alone).unionByName(long).distinct()


_CANDIDATE = "word string, df bigint, restored string, bits bigint, sure boolean"
_CANDIDATE_ARROW = pa.schema([("word", pa.string()), ("df", pa.int64()), ("restored", pa.string()), ("bits", pa.int64()), ("sure", pa.bool_())])
_FOUND = "word string, df bigint, restored string, restored_df bigint, sure boolean, ts array<string>, changes array<string>, spoilt int, strong boolean"
_FOUND_ARROW = pa.schema([("word", pa.string()), ("df", pa.int64()), ("restored", pa.string()), ("restored_df", pa.int64()), ("sure", pa.bool_()), ("ts", pa.list_(pa.string())), ("changes", pa.list_(pa.string())), ("spoilt", pa.int32()), ("strong", pa.bool_())])


def _changes(word: str, restored: str, t: str) -> list[str]:
    """Characters that a byte swap changes, each with what it becomes; UTF-8 readings go one way as a whole."""
    return [""] if t.startswith("utf-8") else sorted({c + d for c, d in zip(word, restored) if c != d})


def _strong(word: str, restored: str, t: str) -> bool:
    return t.startswith("utf-8") or (sum(map(str.isalpha, restored)) >= 3 and any(c not in MISREAD for c, d in zip(word, restored) if c != d))


def _restorations(batch_words: list[str]) -> list[dict[str, int]]:
    """Per word: restored form to the transformations that give it, a bit each.
    Byte swaps run over all words at once, as they keep lengths."""
    by: list[dict[str, int]] = [{} for _ in batch_words]
    joined = "\n".join(batch_words)
    for k, t in enumerate(transformations()):
        if t.startswith("utf-8"):
            first = _sequence(t.split(">")[1])
            for i, w in enumerate(batch_words):
                if first.search(w):
                    r, n = undo(w, t)
                    if n:
                        by[i][r] = by[i].get(r, 0) | 1 << k
        else:
            right, wrong = t.split(">")
            for w, r, mine in zip(batch_words, joined.translate(_swap(wrong, right)).split("\n"), by):
                if r != w:
                    mine[r] = mine.get(r, 0) | 1 << k
    return by


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def _of_bits(bits: int) -> list[str]:
    return [t for k, t in enumerate(transformations()) if bits >> k & 1]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    utf8 = sum(1 << k for k, t in enumerate(transformations()) if t.startswith("utf-8"))
    for b in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
        out = []
        batch_words, dfs = (c.to_pylist() for c in b.columns)
        for word, df, by in zip(batch_words, dfs, _restorations(batch_words)):
            for r, bits in by.items():
                # longer sequences stand for dashes and quotes and turn up in no clean text
                sure = bool(bits & utf8) and len(word) - len(r) > undo(word, _of_bits(bits & utf8)[0])[1]
                out.append((word, df, r, bits, sure))
        yield _arrow(out, _CANDIDATE_ARROW)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a restoration changes, for those that are somebody's right form."""
    for b in batches:
        out = []
        for word, df, r, bits, sure, r_df in zip(*[c.to_pylist() for c in b.columns]):
            ts = _of_bits(bits)
            n = undo(word, ts[0])[1] if ts[0].startswith("utf-8") else sum(c != d for c, d in zip(word, r))
            out.append((word, df, r, r_df, sure, ts, _changes(word, r, ts[0]), n, _strong(word, r, ts[0])))
        yield _arrow(out, _FOUND_ARROW)


def directions(found: DataFrame) -> dict[str, list[str]]:
    """Transformation to the changes that its words prove: those of which
    MORE_COMMON times as many words lead to the commoner word as to the rarer
    one.  A swap and its inverse share all their pairs, and both may occur,
    but each on other characters.  At most some hundred rows a transformation
    are collected."""
    seen = found.where("strong and restored_df is not null").select(F.explode("ts").alias("t"), "changes", "df", "restored_df").select("t", F.explode("changes").alias("c"), F.signum(F.col("restored_df") - F.col("df")).cast("int").alias("s"))
    votes = seen.groupBy("t", "c").agg(F.sum((F.col("s") > 0).cast("int")).alias("pro"), F.sum((F.col("s") < 0).cast("int")).alias("con"))
    out: dict[str, list[str]] = {}
    support: dict[str, int] = {}
    for r in votes.where((F.col("pro") > 0) & (F.col("pro") >= MORE_COMMON * F.col("con"))).orderBy("t", "c").collect():
        out.setdefault(r.t, []).append(r.c)
        support[r.t] = support.get(r.t, 0) + r.pro
    return {t: cs for t, cs in out.items() if support[t] >= WORD_SUPPORT}


def learned_words(types: DataFrame, twins: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """(word, restored, ts, spoilt, strong, known) and the directions.  Known
    are words that a transformation turns into a word of MORE_COMMON times as
    many documents, or into any word not that much rarer if all their changes
    go the transformation's way, and words of twin lines; not known are words
    with sequences of three or more characters for a Latin letter or sign,
    which speak for themselves."""
    vocabulary = types.where("df >= 2").select(F.col("word").alias("restored"), F.col("df").alias("restored_df"))
    near_twins = cut(with_twins(types).repartition(shuffle_partitions(types.sparkSession)))
    joined = near_twins.mapInArrow(_candidates, _CANDIDATE).join(vocabulary, "restored", "left")
    right = joined.where("restored_df is not null or sure").select("word", "df", "restored", "bits", "sure", "restored_df")
    found = cut(right.mapInArrow(_described, _FOUND))
    ways = directions(found)
    common = F.coalesce(F.col("restored_df") >= MORE_COMMON * F.col("df"), F.lit(False))
    near = F.coalesce(F.col("restored_df") * MORE_COMMON > F.col("df"), F.lit(False))
    led = F.array().cast("array<string>")
    if ways:
        way = F.create_map(*[x for t, cs in ways.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in cs]))])
        led = F.filter("ts", lambda t: F.coalesce(F.size(F.array_except("changes", F.try_element_at(way, t))) == 0, F.lit(False)))
    found = found.withColumn("_led", F.when(near, led).otherwise(F.array().cast("array<string>")))
    known = common | (F.size("_led") > 0)
    latin = F.filter("ts", lambda t: t.isin([f"utf-8>{w}" for w in LATIN_READINGS]))
    rows = found.withColumn("known", known).withColumn("ts", F.when(common, F.col("ts")).when(known, F.col("_led")).when(F.col("sure") & ~F.col("restored").rlike(r"[\u0400-\u045F]"), latin)).where(F.size("ts") > 0)
    # twin lines prove their words if nearly all the transformation's lines go this way
    votes = twins.where("word is null").groupBy(F.col("ts")[0].alias("t")).agg(F.sum((F.col("vote") > 0).cast("int")).alias("pro"), F.sum((F.col("vote") < 0).cast("int")).alias("con"))
    clear = [r.t for r in votes.where((F.col("pro") >= TWIN_SUPPORT) & (F.col("pro") >= MORE_COMMON * F.col("con"))).select("t").collect()]
    aligned = twins.where("word is not null").withColumn("ts", F.array_intersect("ts", F.array(*[F.lit(t) for t in clear]).cast("array<string>"))).where(F.size("ts") > 0).groupBy("word", "restored", "ts", "spoilt", "strong").agg(F.count(F.lit(1)).alias("restored_df"))
    columns = ["word", "restored", "ts", "spoilt", "strong", "known", "restored_df"]
    rows = rows.select(*columns).unionByName(aligned.withColumn("known", F.lit(True)).select(*columns))
    best = F.struct("known", "restored_df", "restored")
    learned = rows.groupBy("word").agg(F.max_by(F.struct("restored", "ts", "spoilt", "strong", "known"), best).alias("_b"))
    return learned.select("word", "_b.restored", "_b.ts", "_b.spoilt", F.expr("_b.strong and _b.known").alias("strong"), "_b.known"), ways


def accepted_transformations(learned: DataFrame, twins: DataFrame) -> list[str]:
    """At most as many names as there are transformations, so they are collected."""
    by_words = learned.where("strong").select(F.explode("ts").alias("transformation")).groupBy("transformation").agg(F.count(F.lit(1)).alias("n"))
    by_lines = twins.where("word is null").groupBy(F.col("ts")[0].alias("transformation")).agg(F.count(F.lit(1)).alias("support"))
    rows = by_words.join(by_lines, "transformation", "full_outer").where((F.col("n") >= WORD_SUPPORT) | (F.col("support") >= TWIN_SUPPORT)).select("transformation").collect()
    return sorted(r.transformation for r in rows)


def _odd(word: str) -> int:
    """What clean words lack: capitals after small letters, signs between letters, characters of no text."""
    n = sum(not plausible(c) for c in word)
    n += sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))
    return n + sum(a.isalpha() and c.isalpha() and b in _SIGNS and b not in "’‘‐–—·" for a, b, c in zip(word, word[1:], word[2:]))


def _verdict(word: str, restored: str, name: str, known: dict[str, str], forward: set[str]) -> int:
    """1: garbled, -1: clean, 0: its neighbours tell."""
    if word in known or forward.issuperset(_changes(word, restored, name)):
        return 1
    if not any(map(str.isalpha, word)) and any(map(str.isalpha, restored)):
        return -1
    a, b = _odd(word), _odd(restored)
    return (a > b) - (a < b)


def repair(text: str, name: str, known: dict[str, str], forward: set[str]) -> tuple[str, int]:
    """(text, characters restored) with the stretches of one transformation
    undone.  UTF-8 sequences stand out by themselves.  A byte swap is undone on
    the lines with a known word and those beside them up to one with a clean
    word: in words that are known, of which all changes are proven or which it
    makes less odd, and in those between them that may be either."""
    if name.startswith("utf-8"):
        return undo(text, name)
    table = _swap(*reversed(name.split(">")))
    lines, n = text.split("\n"), 0
    found = []  # by line: (start, end, restored, verdict) of each word that the swap changes
    for line in lines:
        at = [(m.start(), m.end(), m.group(), m.group().translate(table)) for m in _WORD.finditer(line) if not m.group().isascii()]
        found.append([(i, j, known.get(w, r), _verdict(w, r, name, known, forward)) for i, j, w, r in at if known.get(w, r) != w])
    here = [any(lines[k][i:j] in known for i, j, _, _ in f) for k, f in enumerate(found)]
    clean = [any(v < 0 for *_, v in f) for f in found]
    for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        for k in order:
            here[k] = here[k] or (here[k - order.step] and not clean[k - order.step] and not clean[k])
    for k, f in enumerate(found):
        if not here[k]:
            continue
        line, out, end = lines[k], [], 0
        for x, (i, j, r, v) in enumerate(f):
            if v == 0:
                before, after = next((u for *_, u in f[x::-1] if u), 0), next((u for *_, u in f[x:] if u), 0)
                v = 1 if min(before, after) >= 0 else -1
            if v > 0:
                out += [line[end:i], r]
                n += sum(c != d for c, d in zip(line[i:j], r))
                end = j
        lines[k] = "".join([*out, line[end:]])
    return "\n".join(lines), n


def garbled_documents(docs: DataFrame, repairs: bool = True) -> DataFrame:
    """(doc_id, transformation, spoilt, repairs): documents with LEAST_SPOILT or more
    spoilt characters; transformation is null where characters were replaced
    and can't be restored.

    ``docs``: doc_id, text; further columns are ignored, null and empty texts
    are never garbled.  Characters are counted over whole texts.  ``repairs``
    adds what restored_documents needs: every transformation of the document,
    the surest first, with its words.
    """
    parts = cut(spoilable_lines(docs, F.col("text")))
    types = cut(word_types(parts))
    twins = cut(twin_evidence(parts))
    learned, ways = learned_words(types, twins)
    learned = cut(learned)
    names = accepted_transformations(learned, twins)
    usable = F.array_intersect("ts", F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    # a stored table: Spark knows its size and broadcasts it only if that is small
    mapped = cut(learned.withColumn("ts", usable).where(F.size("ts") > 0).select("word", "restored", "ts", F.when(F.col("known"), F.col("spoilt")).otherwise(0).alias("spoilt"), "strong"))
    tokens = parts.select("doc_id", F.explode("words").alias("word")).join(mapped, "word")
    per = (
        tokens.select("doc_id", "word", "restored", "spoilt", "strong", F.explode("ts").alias("transformation"))
        .groupBy("doc_id", "transformation", "word")
        .agg(F.sum("spoilt").alias("spoilt"), F.bool_or("strong").alias("strong"), F.max("restored").alias("restored"))
        .groupBy("doc_id", "transformation")
        .agg(F.sum("spoilt").alias("spoilt"), F.sum(F.col("strong").cast("int")).alias("strong"), F.sum((F.col("spoilt") > 0).cast("int")).alias("known"), F.collect_list(F.struct("word", "restored")).alias("words"))
    )
    utf8 = F.col("transformation").startswith("utf-8")
    # any Cyrillic word is some other Cyrillic word's bytes, so one says less
    cyrillic = F.col("transformation").isin([f"{r}>{w}" for r in FAMILIES["cyrillic"] for w in FAMILIES["cyrillic"] if r != w])
    proven = (F.col("strong") >= 2) | ((F.col("strong") >= 1) & (F.col("known") >= 2) & ~cyrillic)
    per = cut(per.where(utf8 | proven).drop("known"))
    enough = (F.col("spoilt") >= LEAST_SPOILT) & (F.col("strong") >= 1)
    sure = per.where(enough)
    # few known words: count every sequence, and every stretch of a byte swap, of the text under the same transformation
    # (lines without other than ASCII characters hold none and don't part two stretches)
    forward = {t: set(cs) for t, cs in ways.items()}

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, ts, ws, texts = (c.to_pylist() for c in b.columns)
            n = [repair(x, t, {p["word"]: p["restored"] for p in w}, forward.get(t, set()))[1] for t, w, x in zip(ts, ws, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "transformation", "words", "spoilt"])

    pairs = "array<struct<word:string,restored:string>>"
    doubtful = per.where(~enough & (utf8 | (F.col("strong") >= 1)))
    recounted = parts.select("doc_id", F.array_join("lines.line", "\n").alias("text")).join(doubtful.select("doc_id", "transformation", "words"), "doc_id").select("doc_id", "transformation", "words", "text").mapInArrow(recount, f"doc_id bigint, transformation string, words {pairs}, spoilt bigint").withColumn("strong", F.lit(0).cast("bigint"))
    lost = parts.select("doc_id", F.lit(None).cast("string").alias("transformation"), F.col("lost").alias("spoilt"), F.lit(0).cast("bigint").alias("strong"), F.lit(None).cast(pairs).alias("words"))
    found = sure.unionByName(recounted).unionByName(lost).where(F.col("spoilt") >= LEAST_SPOILT)
    rank = F.struct("strong", F.col("transformation").isNotNull(), "spoilt", "transformation")
    whole = [F.max_by("transformation", rank).alias("transformation"), F.max("spoilt").alias("spoilt")]
    if not repairs:
        return found.groupBy("doc_id").agg(*whole)
    led = F.create_map(*[x for t, cs in ways.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in cs]))]) if ways else None
    way = F.lit(None).cast("array<string>") if led is None else F.try_element_at(led, F.col("transformation"))
    one = F.struct("strong", "spoilt", "transformation", way.alias("forward"), "words")
    listed = F.sort_array(F.collect_list(F.when(F.col("transformation").isNotNull(), one)), asc=False)
    return found.groupBy("doc_id").agg(*whole, listed.alias("repairs"))


def _repaired(text: str, repairs: list[dict]) -> str:
    """Transformations one after another; one whose words are gone by then explained the same stretch."""
    for r in repairs:
        known = {p["word"]: p["restored"] for p in r["words"]}
        if any(w in known for w in _WORD.findall(text)):
            text = repair(text, r["transformation"], known, set(r["forward"] or []))[0]
    return text


def restored_documents(docs: DataFrame, garbled: DataFrame) -> DataFrame:
    """(doc_id, transformation, restored): the original text where it can be
    had, else null.  ``garbled`` is what garbled_documents gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, ts, rs, texts = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if t is None else _repaired(x, r) for t, r, x in zip(ts, rs, texts)], pa.string())], names=["doc_id", "transformation", "restored"])

    return docs.select("doc_id", "text").join(garbled.select("doc_id", "transformation", "repairs"), "doc_id").select("doc_id", "transformation", "repairs", "text").mapInArrow(run, "doc_id bigint, transformation string, restored string")
