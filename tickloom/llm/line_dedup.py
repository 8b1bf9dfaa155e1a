"""Corpus-wide line dedup within one edit, by a deletion-neighbourhood join in DataFrame operations only.

Two lines within one insertion, deletion or substitution of a code point have a common deletion variant: the substituted lines lose the
same position, the longer one loses its extra code point. Hashing all variants of all lines would write every
line as often as it is long, so the place of the edit is narrowed down first, without losing a pair:

1. An edit lies in the first or the second half, and the other half is equal. Lines emit the hashes of their halves, for their own
   length and, as the longer line, for one less. Only halves that two lines share go on.
2. The open half is cut into parts of about ``PART`` code points; again, only parts whose surroundings two lines share go on.
3. Those parts emit all their deletion variants. Lines that lose the same position are one edit apart, whichever they are, and so are
   a line and one that becomes equal to it; so the earliest partner of each line is a minimum per variant, and no list of
   lines is ever expanded into pairs.
4. The edit distance of each line and its earliest partners is verified on the whole lines.

A line is dropped if an earlier place in (doc_id, line number) order has the same line, or a line one edit apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import settle

#: Shorter lines (code points, trimmed) are never dropped.
MIN_CHARS = 16
#: Code points of a part before its variants are emitted.
PART = 16

_ID = ("id1", "id2")
_PLACE = ("doc_id", "line_no")


def _line(text: str = "line") -> Column:
    return F.expr(f"trim(BOTH ' \\t\\r' FROM {text})")


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that can be dropped, with its identity (two hashes) and the hashes of its halves."""
    lines = (
        docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
        .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .select("doc_id", "line_no", _line().alias("line"))
        .withColumn("n", F.length("line"))
        .filter(F.col("n") >= MIN_CHARS)
    )
    half = {}
    for role in (0, 1):  # 0: the line itself, 1: as the longer line of one code point less
        cut = f"((n - {role}) div 2)"
        half[f"k{role}0"] = F.expr(f"xxhash64(n - {role}, 0, right(line, cast(n - {role} - {cut} AS int)))")
        half[f"k{role}1"] = F.expr(f"xxhash64(n - {role}, 1, left(line, cast({cut} AS int)))")
    return lines.select(*_PLACE, F.xxhash64("line").alias("id1"), F.expr("xxhash64(line, 1)").alias("id2"), *(x.alias(k) for k, x in half.items()))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key at least two lines have, one of them in its own length."""
    over = Window.partitionBy(key)
    return rows.withColumn("lines", F.count("*").over(over)).withColumn("own", F.min("role").over(over)).filter("lines > 1 AND own = 0").drop("lines", "own")


def _parts(segments: DataFrame) -> DataFrame:
    """Cut ``seg`` (m code points, one more in role 1) into parts; the key takes in what lies around the part."""
    count = f"greatest(1, ceil(m / {PART}))"
    rows = segments.withColumn("p", F.explode(F.expr(f"sequence(0, cast({count} - 1 AS int))")))
    rows = rows.withColumn("s", F.expr(f"cast(floor(m * p / {count}) AS int)")).withColumn("e", F.expr(f"cast(floor(m * (p + 1) / {count}) AS int)"))
    return rows.select(
        *_ID, *_PLACE, "role",
        F.expr("xxhash64(key, m, p, left(seg, s), right(seg, cast(m - e AS int)))").alias("key"),
        F.expr("substring(seg, s + 1, e - s + role)").alias("seg"),
    )


def _variants(segments: DataFrame) -> DataFrame:
    """All deletion variants of ``seg`` as two hashes; ``whole`` marks those that a line has or becomes without its extra code point."""
    cut = lambda i: F.concat(F.expr(f"left(seg, {i} - 1)"), F.expr(f"substring(seg, {i} + 1)"))
    rows = segments.withColumn("i", F.explode(F.expr("sequence(role, length(seg))")))
    # role 0, i = 0: the line itself; role 0, i > 0: one substituted at i; role 1: the longer line without i
    whole = F.col("role").eqNullSafe(1) | (F.col("i") == 0)
    text = F.when(F.col("i") == 0, F.col("seg")).otherwise(cut("i"))
    at = F.when(whole, 0).otherwise(F.col("i"))
    return rows.select(*_ID, *_PLACE, "role", whole.alias("whole"), F.xxhash64("key", at, text).alias("v1"), F.xxhash64(text, "key", at, F.lit(1)).alias("v2"))


def _near(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids of lines with an earlier first place of a line one edit apart."""
    first = F.min(F.struct(*_PLACE)).alias("first")
    once = lines.groupBy(*_ID).agg(first, *(F.first(k).alias(k) for k in ("k00", "k01", "k10", "k11"))).select(*_ID, "first.*", "k00", "k01", "k10", "k11")
    sides = [F.struct(F.lit(role).alias("role"), F.lit(p).alias("p"), F.col(f"k{role}{p}").alias("key")) for role in (0, 1) for p in (0, 1)]
    halves = once.select(*_ID, *_PLACE, F.explode(F.array(*sides)).alias("h")).select(*_ID, *_PLACE, "h.*")
    wanted = _shared(halves, "key").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", *_ID, "role", "p", "key")).alias("wanted"))
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").join(wanted, "doc_id")
    # a row gets its own line only, not the whole text; n_lines is kept so that the lines are cut once per text, not once per wanted line
    texts = texts.select("doc_id", "wanted", F.split("text", "\n", -1).alias("own"))
    picked = F.transform("wanted", lambda w: F.struct(w.alias("w"), F.get("own", w["line_no"]).alias("raw")))
    texts = texts.select("doc_id", F.size("own").alias("n_lines"), F.explode(picked).alias("x"))
    open_lines = settle(texts.select("doc_id", "n_lines", "x.w.*", _line("x.raw").alias("line")).filter("xxhash64(line) = id1"))
    n = "length(line)"
    segment = F.expr(f"CASE WHEN p = 0 THEN left(line, cast((({n} - role) div 2) + role AS int)) ELSE substring(line, cast((({n} - role) div 2) + 1 AS int)) END")
    segments = open_lines.withColumn("seg", segment).withColumn("m", F.length("seg") - F.col("role"))
    rows = _variants(_shared(_parts(segments), "key").distinct())
    variant = Window.partitionBy("v1", "v2")
    me = F.struct(*_PLACE, *_ID)
    least = lambda keep: F.min(F.when(keep, me)).over(variant)
    partner = F.when(~F.col("whole"), least(~F.col("whole"))).when(F.col("role") == 0, least(F.col("role") == 1)).otherwise(least(F.col("role") == 0))
    pairs = rows.withColumn("partner", partner).filter(F.col("partner") < me).select(*_ID, F.col("partner.id1").alias("to1"), F.col("partner.id2").alias("to2")).distinct()
    texts = open_lines.select(*_ID, "line").distinct()
    other = texts.select(F.col("id1").alias("to1"), F.col("id2").alias("to2"), F.col("line").alias("other"))
    return pairs.join(texts, list(_ID)).join(other, ["to1", "to2"]).filter(F.expr("levenshtein(line, other, 1) = 1")).select(*_ID).distinct()


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, id1, near`` of every line to drop; near: a line one edit apart stands earlier, else only copies do.

    Lines are cut at line feeds and numbered from 0, white space at their ends is not compared. Lines under MIN_CHARS code points stay. Rows
    with a null id or text lose nothing and count for nothing. Rows that share an id are one document: a line counts as one place if it is the same
    with the same number. Empty tables give empty results; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    lines = settle(_lines(docs))
    near = _near(docs, lines).withColumn("near", F.lit(True))
    copies = lines.groupBy(*_ID).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("places")).filter("places > 1").drop("places")
    fates = copies.join(near, list(_ID), "full_outer")
    return (
        lines.select(*_PLACE, *_ID)
        .join(fates, list(_ID))
        .withColumn("near", F.coalesce("near", F.lit(False)))
        .filter(F.col("near") | (F.struct(*_PLACE) > F.col("first")))
        .select(*_PLACE, "id1", "near")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the dropped lines taken out of ``text``, and ``n_dropped`` for each row.

    A text of which every line was dropped becomes empty. Rows with a null id or text come back unchanged.
    """
    lost = dropped_lines(docs).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "id1")).alias("lost__"))
    joined = docs.withColumn("id__", F.col("doc_id").cast("long")).join(lost.withColumnRenamed("doc_id", "id__"), "id__", "left")
    own = F.split("text", "\n", -1)
    # the row's own lost lines in order (another row with the same id may have lost others), then the stretches between them
    mine = F.filter("lost__", lambda e: F.xxhash64(F.trim(F.get("own__", e["line_no"]), F.lit(" \t\r"))) == e["id1"])
    cut = joined.withColumn("own__", F.when(F.col("lost__").isNotNull(), own)).withColumn("nos__", F.array_sort(F.transform(mine, lambda e: e["line_no"])))
    before, after = F.concat(F.array(F.lit(-1)), "nos__"), F.concat("nos__", F.array(F.size("own__")))
    stretches = F.zip_with(before, after, lambda a, b: F.slice("own__", a + 2, b - a - 1))
    cut = cut.withColumn("kept__", F.flatten(stretches)).withColumn("n_dropped", F.coalesce(F.size("nos__"), F.lit(0)))
    cut = cut.withColumn("n_dropped", F.when(F.col("lost__").isNull(), 0).otherwise(F.col("n_dropped")).cast("int"))
    return cut.withColumn("text", F.when(F.col("lost__").isNull(), F.col("text")).otherwise(F.array_join("kept__", "\n"))).drop("lost__", "id__", "own__", "nos__", "kept__")


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, n_near, dropped`` for each row; dropped lists the line numbers, ascending and comma-joined.

    A null text has 0 lines, an empty one has 1.
    """
    lost = dropped_lines(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_dropped"), F.count_if("near").alias("n_near"), F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("dropped")
    )
    sized = docs.select(F.col("doc_id").cast("long"), F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return sized.join(lost, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped", F.lit("")).alias("dropped"))


#: DuckDB statement for line_report over a table of that name: lines of equal or neighbouring length that share a half, compared code point by code point.
REPORT_SQL = f"""
WITH pieces AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), lines AS (
  SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM pieces WHERE length(trim(raw, ' ' || chr(9) || chr(13))) >= {MIN_CHARS}
), firsts AS (
  SELECT line, length(line) AS n, min({{'d': doc_id, 'l': line_no}}) AS place FROM lines GROUP BY line
), pairs AS (
  SELECT a.line AS x, b.line AS y, a.place AS px, b.place AS py FROM firsts a JOIN firsts b ON a.n = b.n AND left(a.line, (a.n // 2)::INT) = left(b.line, (b.n // 2)::INT) WHERE a.place < b.place
  UNION ALL
  SELECT a.line, b.line, a.place, b.place FROM firsts a JOIN firsts b ON a.n = b.n AND right(a.line, (a.n - a.n // 2)::INT) = right(b.line, (b.n - b.n // 2)::INT) WHERE a.place < b.place
  UNION ALL
  SELECT a.line, b.line, a.place, b.place FROM firsts a JOIN firsts b ON a.n = b.n - 1 AND left(a.line, (a.n // 2)::INT) = left(b.line, ((b.n - 1) // 2)::INT)
  UNION ALL
  SELECT a.line, b.line, a.place, b.place FROM firsts a JOIN firsts b ON a.n = b.n - 1 AND right(a.line, (a.n - a.n // 2)::INT) = right(b.line, (b.n - 1 - (b.n - 1) // 2)::INT)
), near AS (
  SELECT DISTINCT CASE WHEN px < py THEN y ELSE x END AS line FROM pairs
  WHERE list_bool_or([left(x, i::INT) = left(y, i::INT) AND substr(x, (i + CASE WHEN length(x) = length(y) THEN 2 ELSE 1 END)::INT) = substr(y, (i + 2)::INT) FOR i IN range(0, length(y))])
), lost AS (
  SELECT l.doc_id, l.line_no, n.line IS NOT NULL AS near FROM lines l JOIN firsts f ON l.line = f.line LEFT JOIN near n ON n.line = l.line
  WHERE n.line IS NOT NULL OR {{'d': l.doc_id, 'l': l.line_no}} > f.place
), summed AS (
  SELECT doc_id, count(*) AS n_dropped, count(*) FILTER (WHERE near) AS n_near, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped FROM lost GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(s.n_dropped, 0) AS n_dropped, coalesce(s.n_near, 0) AS n_near, coalesce(s.dropped, '') AS dropped
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""
