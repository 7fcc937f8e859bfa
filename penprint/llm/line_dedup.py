"""Operator 9: corpus-wide line deduplication with a segment-partition edit join.

A line goes when an equal line, or one within ``edits`` edits, occurs earlier (by doc_id,
text hash, line number).  The bound grows with the shorter line's length up to ``least`` characters
(two edits and 24: one from 12 characters on, two from 24 on), as two edits turn any word into another.  Equal lines meet in one aggregate.  For near ones, a line is cut
into ``edits + 1`` even segments; a line within ``edits`` edits and no shorter holds one of
them unchanged, at a shift that its length and the segment's number bound, so each line
posts its segments and probes those substrings of itself that could be a segment of a line
of each admissible length.  Lines sharing a key are verified with Hyyro's banded
bit-parallel edit distance, their common ends cut off: a band of ``2 * edits + 1`` rows is one integer, updated once a
character.

Only DataFrame functions run here: no Python on the executors.

Scale: line text is not shuffled.  First occurrences are aggregates over two 64-bit hashes
with map-side combine, so a line repeated everywhere is one row a task; a line's keys are
made in one pass and meet by line hash before they become rows.  A key row is two 64-bit
values: the line, and a hash of the key beside a signature of letter counts modulo 4 in
Gray code, of which an edit changes two bits at most.  The keys are dealt once and joined with themselves by a
semi join: what is left are the key rows with a partner of another line and close letters, one
row each however large their group.  Only whether an *earlier* near line exists decides, so
no pair list is made: in rounds, the rows of a key meet its ``LEADERS`` earliest lines, those
found near are decided, and the others go on; after ``ROUNDS`` rounds the undecided rest meets all
lines left in its groups.  A cluster of near copies is decided by
its first lines.  Text is fetched for lines with a partner only, by a join that broadcasts
their hashes up to ``BROADCAST_ROWS`` and shuffles beyond.  Each document's dropped line
numbers join back to it by a hash join built on that narrower side, which shuffles the texts
of the documents once.

Defined cases: a null text stays null and has no lines; blank lines always stay and are not
counted; lines too short for an edit (under 12 characters) are compared exactly only; rows equal in
doc_id and text are one document and are treated alike; a null doc_id sorts first; a text
that loses lines keeps the others in order; extra columns pass through, and columns named
like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import written

EDITS = 2
LEAST = 24                 # characters from which EDITS apply; shorter lines in proportion
LINE_BREAK = "\n"
LETTERS = "etaoinshrdlu"   # any ASCII letters are right; frequent ones tell lines apart
POSTED = 1                 # the bit of a line's own segments, beside two bits a letter
KEY_SHIFT = 1 + 2 * len(LETTERS)
SIGNS = "etaoinshrdlucmfwypgbvk .,0123456"         # any different ASCII characters are right
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar",
         "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co")      # any of two different ASCII characters
LEADERS = 16               # earliest lines of a key that a round compares with
ROUNDS = 1
LONGEST_STEP = 1 << 12
BROADCAST_ROWS = 200_000   # of at most 40 bytes


def segment(length: Column, k: int, i: int) -> tuple[Column, Column]:
    """0-based start and length of segment i of k even segments (longer ones last)."""
    base = F.floor(length / k).cast("int")
    short = F.lit(k) - (length - base * k)
    return base * i + F.greatest(F.lit(i) - short, F.lit(0)), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def shortest(edits: int, least: int) -> int:
    """Characters of the shortest line to which an edit is allowed."""
    return -(-least // edits)


def allowed(length: Column, edits: int, least: int) -> Column:
    """Edits allowed between lines the shorter of which has so many characters."""
    return F.least(F.lit(edits), F.floor(length * edits / least)).cast("int")


def _key(line: Column, length: Column, i: int, start: Column, n: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substr(line, (start + 1).cast("int"), n.cast("int")))


def line_keys(line: Column, length: Column, edits: int, least: int) -> tuple[list[Column], list[Column]]:
    """Keys of a line's own segments, and of its substrings that may equal a segment of a line
    no longer; a key is null where a substring would leave the line.  Only shifts that leave
    at most i edits before segment i and the rest after it are needed; at the same length
    and place the own key serves."""
    k = edits + 1
    own = [_key(line, length, i, *segment(length, k, i)) for i in range(k)]
    probes = []
    for shorter in range(edits + 1):
        other = length - shorter
        for i in range(k):
            start, n = segment(other, k, i)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                if shorter or shift:
                    at = start + shift
                    fits = (other >= shortest(edits, least)) & (at >= 0) & (at + n <= length)
                    probes.append(F.when(fits, _key(line, other, i, at, n)))
    return own, probes


def count_bits(line: Column, signs) -> Column:
    """The count of each one-character sign modulo 4, two bits a sign from the lowest."""
    bits = F.lit(0).cast("long")
    for k, sign in enumerate(signs):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(sign), F.lit("")))
        bits = bits.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(3)).cast("long"), 2 * k))
    return bits


def gray(bits: Column) -> Column:
    """Such counts in Gray code: the bits in which two values differ are at most the steps between
    their counts."""
    return bits.bitwiseXOR(F.shiftright(bits, 1).bitwiseAND(F.lit(0x5555555555555555)))


def count_code(line: Column, signs) -> Column:
    """Counts of signs of one size in Gray code, the bits of the first sign highest: one small
    expression over the list of signs, for the few lines that have a partner."""
    def add(bits: Column, sign: Column) -> Column:
        count = F.octet_length(line) - F.octet_length(F.replace(line, sign, F.lit("")))
        return F.shiftleft(bits, 2).bitwiseOR(F.shiftright(count, len(signs[0]) - 1).bitwiseAND(F.lit(3)).cast("long"))

    return F.aggregate(F.array(*[F.lit(x) for x in signs]), F.lit(0).cast("long"), add, gray)


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once."""
    return F.transform(F.array(value), body)[0]


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``edits``; exact up to
    ``edits``, some larger number beyond.  Band bit r of column i stands for row
    ``i - edits + r``; the last row leaves the band's lower edge after ``length(a) - edits``
    columns, and from there the horizontal deltas of that row are followed."""
    k, w = edits, 2 * edits + 1
    full = (1 << w) - 1

    def invert(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(full))

    def step(s: Column, i: Column, p: Column, t: Column) -> Column:
        m = F.size(p)
        char = t[i]
        eq = F.lit(0)
        for r in range(w):
            row = i - k + r
            hit = F.when((row >= 0) & (row < m), (F.get(p, row) == char).cast("int")).otherwise(0)
            eq = eq.bitwiseOR(F.shiftleft(hit, r))

        def with_eq(x: Column) -> Column:
            d0 = (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]) \
                .bitwiseAND(F.lit(full))
            return _let(d0, with_d0)

        def with_d0(d0: Column) -> Column:
            hp = s["vn"].bitwiseOR(invert(d0.bitwiseOR(s["vp"])))
            hn = d0.bitwiseAND(s["vp"])
            return _let(F.struct(d0.alias("d0"), hp.alias("hp"), hn.alias("hn")), last)

        def last(x: Column) -> Column:
            down = F.shiftright(x["d0"], 1)
            edge = F.when(F.shiftright(x["d0"], 2 * k).bitwiseAND(F.lit(1)) == 0, 1).otherwise(0)
            place = m - 1 - i + k
            across = F.when(place < 0, 0).otherwise(
                F.call_function("getbit", x["hp"], F.greatest(place, F.lit(0))).cast("int")
                - F.call_function("getbit", x["hn"], F.greatest(place, F.lit(0))).cast("int"))
            return F.struct(
                x["hn"].bitwiseOR(invert(down.bitwiseOR(x["hp"]))).alias("vp"),
                down.bitwiseAND(x["hp"]).alias("vn"),
                (s["d"] + F.when(i < m - k, edge).otherwise(across)).alias("d"))

        return _let(eq, with_eq)

    begin = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
    both = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t"))
    run = _let(both, lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x["t"]) - 1), begin,
                                           lambda s, i: step(s, i, x["p"], x["t"]))["d"])
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(run)


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings begin with alike, up to ``2 * LONGEST_STEP - 1``."""
    least = F.least(F.length(a), F.length(b))

    def grow(p: Column, step: Column) -> Column:
        alike = (p + step <= least) & (F.substr(a, p + 1, step) == F.substr(b, p + 1, step))
        return F.when(alike, p + step).otherwise(p)

    steps = [F.lit(1 << k) for k in reversed(range(LONGEST_STEP.bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), grow)


def trimmed_distance(a: Column, b: Column, edits: int) -> Column:
    """``banded_distance`` without the common ends, which cost no edit, but for ``edits`` characters
    of each, as the band needs rows of its own height."""
    def rest(x: Column, y: Column, p: Column) -> Column:
        return F.struct(*[F.reverse(F.substr(v, F.greatest(p - edits, F.lit(0)) + 1, F.length(v))).alias(n)
                          for v, n in ((x, "a"), (y, "b"))])

    def inner(x: Column) -> Column:
        return _let(rest(x["a"], x["b"], common_prefix(x["a"], x["b"])), lambda y: _let(
            rest(y["a"], y["b"], common_prefix(y["a"], y["b"])), lambda z: banded_distance(z["a"], z["b"], edits)))

    return _let(F.struct(a.alias("a"), b.alias("b")), inner)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("th"),
                       F.posexplode(F.split(F.col(text_col), LINE_BREAK, -1)).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(r"\S"))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def partnered(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(h1, k): the key rows that another line shares, posted by one of the two, with nearly its
    letters; k is the key's hash above the signature and the posted bit."""
    line, length = F.col("line"), F.col("length")
    # The counts are a column of their own, so that the plan holds their expression once.
    rows = (lines.select("h1", "line", F.length("line").alias("length")).where(length >= shortest(edits, least))
            .withColumn("counts", count_bits(line, LETTERS)).withColumn("marks", F.shiftleft(gray(F.col("counts")), 1)))
    own, probes = line_keys(line, length, edits, least)
    below = (1 << KEY_SHIFT) - 1
    marks = F.col("marks")
    packed = ([k.bitwiseAND(F.lit(~below)).bitwiseOR(marks).bitwiseOR(F.lit(POSTED)) for k in own]
              + [k.bitwiseAND(F.lit(~below)).bitwiseOR(marks) for k in probes])
    # One row a distinct line before the explode: copies of a line are one row a task.
    wide = rows.groupBy("h1").agg(*[F.max(k.cast("long")).alias(f"k{n}") for n, k in enumerate(packed)])
    keys = (wide.select("h1", F.explode(F.array(*[F.col(f"k{n}") for n in range(len(packed))])).alias("k"))
            .where(F.col("k").isNotNull()))
    other = keys.toDF("o1", "o")
    shared = (F.shiftright("k", KEY_SHIFT) == F.shiftright("o", KEY_SHIFT)) & (F.col("h1") != F.col("o1"))
    posted = F.col("k").bitwiseOR(F.col("o")).bitwiseAND(F.lit(POSTED)) != 0
    letters = F.lit(below & ~POSTED)
    close = bits_apart(F.col("k").bitwiseAND(letters), F.col("o").bitwiseAND(letters)) <= 2 * edits
    return keys.join(other, shared & posted & close, "left_semi")


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast only if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def near_lines(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(h1, h2): the lines within the allowed edits of a different line that occurs earlier."""
    rows = written(partnered(lines, edits, least), "line-keys")
    wanted = written(rows.select("h1").distinct(), "line-keys")
    text = written(lines.join(sized(wanted), "h1").groupBy("h1", "h2")
                   .agg(F.min(F.struct("d", "th", "pos")).alias("first"), F.min("line").alias("line"))
                   .withColumns({"signs": count_code(F.col("line"), SIGNS), "pairs": count_code(F.col("line"), PAIRS)}), "line-texts")
    known = rows.select("h1", F.shiftright("k", KEY_SHIFT).alias("key")).distinct().join(text.drop("line"), "h1")
    open_ = pool = written(known.join(_as_other(known), (F.col("key") == F.col("okey")) & _signs_close(edits)
                                      & ((F.col("h1") != F.col("o1")) | (F.col("h2") != F.col("o2"))), "left_semi"), "line-groups")
    found = None
    for turn in range(ROUNDS + 1):
        target = pool
        if turn < ROUNDS:
            rank = F.row_number().over(Window.partitionBy("key").orderBy("first", "h1", "h2"))
            target = written(pool.withColumn("rank", rank).where(F.col("rank") <= LEADERS).drop("rank"), "line-leaders")
        decided = written(_near_earlier(open_, target, text, edits, least), "line-near")
        found = decided if found is None else found.union(decided)
        if turn == ROUNDS:
            break
        same = ["key", "h1", "h2"]
        pool = pool.join(target, same, "left_anti")
        # A leader has met every line of its key that is earlier than itself.
        open_ = written(open_.join(target, same, "left_anti").join(decided, ["h1", "h2"], "left_anti"), "line-groups")
        if open_.isEmpty():
            break
    return written(found.distinct(), "line-near")


def _as_other(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("okey"), F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("earlier"),
                       F.col("signs").alias("osigns"), F.col("pairs").alias("opairs"))


def _signs_close(edits: int) -> Column:
    """An edit moves the counts of two characters, and of four pairs, by one at most."""
    return ((bits_apart(F.col("signs"), F.col("osigns")) <= 2 * edits)
            & (bits_apart(F.col("pairs"), F.col("opairs")) <= 4 * edits))


def _near_earlier(rows: DataFrame, target: DataFrame, text: DataFrame, edits: int, least: int) -> DataFrame:
    """(h1, h2) of ``rows`` near an earlier line of ``target`` that shares a key."""
    met = (rows.join(_as_other(target), (F.col("key") == F.col("okey")) & (F.col("earlier") < F.col("first")) & _signs_close(edits))
           .select("h1", "h2", "o1", "o2").distinct())
    pairs = (met.join(text.select("h1", "h2", F.col("line").alias("a")), ["h1", "h2"])
             .join(text.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("b")), ["o1", "o2"]))
    return (pairs.where(F.abs(F.length("a") - F.length("b")) <= edits)
            .where(trimmed_distance(F.col("a"), F.col("b"), edits)
                   <= allowed(F.least(F.length("a"), F.length("b")), edits, least)).select("h1", "h2").distinct())


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(d, th, pos, near): line occurrences to drop; near tells a near copy from an exact one."""
    lines = _lines(docs, id_col, text_col)
    places = lines.select("d", "th", "pos", "h1", "h2")
    near = sized(near_lines(lines, edits, least)).withColumn("near", F.lit(True))
    marked = (places.groupBy("h1", "h2").agg(F.min(F.struct("d", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("copies"))
              .join(near, ["h1", "h2"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
              .where((F.col("copies") > 1) | F.col("near")).drop("copies"))
    return (places.join(sized(written(marked, "line-marks")), ["h1", "h2"])
            .where(F.col("near") | ~F.struct("d", "th", "pos").eqNullSafe(F.col("first")))
            .select("d", "th", "pos", "near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` with the lines dropped from the text, and lines_in, lines_exact, lines_near:
    its non-blank lines, and those dropped as equal or near copies."""
    gone = (dropped_lines(docs, id_col, text_col, edits, least).groupBy("d", "th")
            .agg(F.sort_array(F.collect_set("pos")).alias("__line_gone"),
                 F.size(F.collect_set(F.when(F.col("near"), F.col("pos")))).alias("__line_near")))
    gone = gone.select(F.col("d").alias("__line_doc"), F.col("th").alias("__line_text"), "__line_gone", "__line_near").hint("shuffle_hash")
    rows = docs.withColumn("__line_hash", F.xxhash64(F.col(text_col)))
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col("__line_doc")) & (F.col("__line_hash") == F.col("__line_text")), "left")
    parts = F.split(F.col(text_col), LINE_BREAK, -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("__line_gone"), i)), LINE_BREAK)
    return (rows.withColumn("lines_in", F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(r"\S"))), F.lit(0)))
            .withColumn("lines_near", F.coalesce("__line_near", F.lit(0)))
            .withColumn("lines_exact", F.coalesce(F.size("__line_gone"), F.lit(0)) - F.col("lines_near"))
            .withColumn(text_col, F.when(F.col("__line_gone").isNull(), F.col(text_col)).otherwise(kept))
            .drop("__line_hash", "__line_doc", "__line_text", "__line_gone", "__line_near"))


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: its line counts and the SHA-256 of the text that is left."""
    found = dedup_lines(docs.select(id_col, text_col), id_col, text_col, **options)
    return found.select(F.col(id_col).alias("doc_id"), "lines_in", "lines_exact", "lines_near",
                        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))


# DuckDB: the same rows from a plain join of distinct lines of nearly equal length.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
full_lines AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
distinct_lines AS (
  SELECT line, length(line) AS n, min(struct_pack(d := doc_id, p := pos)) AS f FROM full_lines GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM distinct_lines a JOIN distinct_lines b
    ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} AND a.f < b.f
  WHERE least(a.n, b.n) >= {shortest(EDITS, LEAST)}
    AND levenshtein(a.line, b.line) <= least({EDITS}, least(a.n, b.n) * {EDITS} // {LEAST})),
judged AS (
  SELECT l.doc_id, l.pos, l.line, x.line IS NOT NULL AS is_near,
         x.line IS NULL AND d.f <> struct_pack(d := l.doc_id, p := l.pos) AS is_copy
  FROM full_lines l JOIN distinct_lines d USING (line) LEFT JOIN near x ON x.line = l.line),
texts AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos)
           FILTER (WHERE NOT coalesce(j.is_near OR j.is_copy, false)) AS text,
         count(j.pos) AS lines_in, count(*) FILTER (WHERE j.is_copy) AS lines_exact,
         count(*) FILTER (WHERE j.is_near) AS lines_near
  FROM lines l LEFT JOIN judged j ON j.doc_id = l.doc_id AND j.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(t.lines_in, 0)::INTEGER AS lines_in, coalesce(t.lines_exact, 0)::INTEGER AS lines_exact,
       coalesce(t.lines_near, 0)::INTEGER AS lines_near, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
