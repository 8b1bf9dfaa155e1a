"""Text components: sentences, category patterns, context of image rows, strategy parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# fixed values: pattern dictionary, in order of precedence
PATTERNS = {
    "MATH": [r"\b\d{2,}\b", r"square of \d+", r"root of \d+", r"price level", r"range"],
    "GEOMETRY": [r"\d+x\d+ angles?", r"\d+\s*degrees?", r"geometric", r"triangle", r"square", r"circle", r"45 deg"],
    "TIME": [
        r"\d+\s*days?", r"\d+\s*weeks?", r"\d+\s*months?", r"\d+\s*years?", r"cycle", r"anniversary", r"season", r"periodic",
    ],
    "MECHANICAL": [r"buy\s+at", r"sell\s+at", r"stop\s+loss", r"if\s+.*then", r"rule \d+"],
}
REPORT_ORDER = ("MECHANICAL", "MATH", "GEOMETRY", "TIME", "VISUAL-LOGIC", "VEILED", "Visual-Logic")

# a sentence ends at a full stop or question mark and space, not after "e.g." or "Mr."
SENTENCE_END = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"


# letters, digits, spaces and case follow Unicode
UNICODE = "(?iuU)"


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per non-empty sentence with its position; a document is one row, so work splits by document."""
    parts = F.split(collapse_space(F.col(text)), SENTENCE_END)
    out = documents.select(*keys, text).select(*keys, F.posexplode(parts).alias("position", "sentence"))
    return out.withColumn("sentence", F.trim("sentence")).where(F.col("sentence") != "")


def category_hits(rows: DataFrame, patterns: dict[str, list[str]] = PATTERNS, text: str = "sentence") -> DataFrame:
    """``hits_<category>``: how many of a category's patterns occur, ignoring case."""
    count = lambda regs: sum((F.col(text).rlike(UNICODE + r).cast("int") for r in regs), F.lit(0))
    return rows.withColumns({f"hits_{name}": count(regs) for name, regs in patterns.items()})


def components(rows: DataFrame, keys: list[str], patterns: dict[str, list[str]] = PATTERNS) -> DataFrame:
    """Sentences with at least one hit: id, main category (most hits, first on ties) and parameters.

    Every pattern is tried once per sentence: the found ones are one array inside a generator, which neither a filter nor a projection can copy, and hits,
    category and parameters are read from it. Sentences are dealt out by a hash, since few files may hold all the text.
    """
    at = 0
    tried = F.array(*[F.col("sentence").rlike(UNICODE + r) for regs in patterns.values() for r in regs])
    spans = {}
    for name, regs in patterns.items():
        spans[name], at = (at, len(regs)), at + len(regs)
    some = F.filter(F.array(F.struct(tried.alias("found"))), lambda x: F.array_contains(x["found"], True))
    hit = rows.select(*keys, "position", "sentence").repartition(*keys, "position").select(*keys, "position", "sentence", F.inline(some))
    count = lambda name: F.size(F.filter(F.slice("found", spans[name][0] + 1, spans[name][1]), lambda x: x))
    ranked = F.array_max(F.array(*[F.struct(count(n).alias("hits"), F.lit(-i).alias("early"), F.lit(n).alias("name")) for i, n in enumerate(patterns)]))
    found = [F.when(F.get("found", F.lit(spans["GEOMETRY"][0] + k)), F.lit(r)) for k, r in enumerate(patterns.get("GEOMETRY", []))]
    listed = F.concat(F.lit("Found: ['"), F.array_join(F.array_compact(F.array(*found)), "', '"), F.lit("']"))
    return hit.withColumn("_best", ranked).select(
        *keys,
        F.concat_ws("_", F.lit("TXT"), *keys, "position").alias("component_id"),
        F.lit("Text").alias("source_type"),
        F.col("_best.name").alias("logic_type"),
        F.when(F.col("_best.name") == "GEOMETRY", listed).otherwise("N/A").alias("parameters"),
        F.col("sentence").alias("definition"),
    )


def page_context(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """Each page with the previous page of its document in front.

    A page joins its predecessor by page number, so a document of any length needs no ordered window;
    page numbers must be consecutive.
    """
    flat = F.trim(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))
    here = pages.withColumn("current_text", flat)
    before = here.select(doc, (F.col(page) + 1).alias(page), F.col("current_text").alias("previous_text"))
    out = here.join(before, [doc, page], "left").withColumn("previous_text", F.coalesce("previous_text", F.lit("")))
    return out.withColumn("combined_text", F.concat("previous_text", F.lit(" [PAGE BREAK] "), "current_text"))


def image_context(context: DataFrame, page: str) -> DataFrame:
    """Parameters and context for image rows from the text around them.

    Angles and concepts are listed once each in sorted order; the context is the sentence holding
    "chart", else the first 1000 characters; a page with little text cites the page before.
    """
    combined = F.col("combined_text")
    listed = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(combined, F.lit("(?i)(" + pattern + ")"), 1)))
    angles = listed(r"\d+x\d+ angles?|\d+\s*degrees?")
    concepts = listed(r"triangle|square|circle|cycle|resistance level")
    out = context.withColumns({"_angles": angles, "_concepts": concepts})
    told = F.concat_ws(
        " | ",
        F.when(F.size("_angles") > 0, F.concat(F.lit("Angles mentioned: "), F.array_join("_angles", ", "))),
        F.when(F.size("_concepts") > 0, F.concat(F.lit("Concepts: "), F.array_join("_concepts", ", "))),
    )
    chart = F.regexp_extract(combined, r"(?i)([^.]*?Chart[^.]*\.)", 1)
    relevant = F.when(chart != "", chart).otherwise(F.concat(F.substring(combined, 1, 1000), F.lit("...")))
    source = F.when(
        F.length("current_text") < 50, F.concat(F.lit("Page "), F.col(page).cast("string"), F.lit(" (Preceding)"))
    ).otherwise(F.concat(F.lit("Pages "), F.col(page).cast("string"), F.lit(" & "), (F.col(page) + 1).cast("string")))
    return out.withColumns(
        {
            "parameters": F.when(told == "", "See context text").otherwise(told),
            "definition": F.concat(F.lit("Context from "), source, F.lit(': "'), relevant, F.lit('"')),
        }
    ).drop("_angles", "_concepts")


def extract_parameters(rows: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Strategy parameters per kind: day periods, angles up to 360, cycles, stop-loss sentences.

    ``rows`` has ``logic_type`` and ``definition``; the result is one row per distinct value, or per
    mention with ``keep_duplicates``, with how often it was named. Values stay rows: a value list of a
    large corpus would not fit one row.
    """
    low = F.lower("definition")
    pick = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    number = lambda v: v.try_cast("decimal(38,0)").cast("string")  # noqa: E731  07 and 7 are one value
    days = pick("time_period", F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)\s*[- ]?days?"), 1), number))
    stops = F.when(low.contains("stop loss"), F.array(F.struct(F.lit("stop_loss").alias("kind"), F.col("definition").alias("value")))).otherwise(none)
    angles = pick("angle", F.filter(F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)\s*degrees?"), 1), number), lambda v: v.try_cast("int") <= 360))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)\s*(days?|weeks?|months?|years?)"), 1), number)
    units = F.regexp_extract_all(low, F.lit(r"(\d+)\s*(days?|weeks?|months?|years?)"), 2)
    cycles = pick("cycle", F.zip_with(numbers, units, lambda n, u: F.concat_ws(" ", n, u)))
    kind = F.col("logic_type")
    found = (
        F.when(kind == "MECHANICAL", F.concat(days, stops))
        .when(kind.isin("GEOMETRY", "VISUAL-LOGIC"), angles)
        .when(kind == "TIME", cycles)
        .otherwise(none)
    )
    values = rows.select(F.inline(found))
    return values if keep_duplicates else values.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("mentions"))


def component_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Components in report order, definitions cut to 200 characters with an ellipsis."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(REPORT_ORDER):
        rank = F.when(F.col("logic_type") == name, i).otherwise(rank)
    cut = F.substring(F.replace("definition", F.lit("\n"), F.lit(" ")), 1, 200)
    return (
        rows.withColumn("section", F.coalesce(rank, F.lit(len(REPORT_ORDER))))
        .withColumn("definition", F.when(F.length(cut) == 200, F.concat(cut, F.lit("..."))).otherwise(cut))
        .withColumn("parameters", F.when(F.col("parameters") == "N/A", "").otherwise(F.col("parameters")))
        .select("section", "logic_type", *keys, "component_id", "definition", "parameters")
        .orderBy("section", "logic_type", *keys, "component_id")
    )


def category_totals(rows: DataFrame) -> DataFrame:
    """Components per category."""
    return rows.groupBy("logic_type").agg(F.count(F.lit(1)).alias("components"))
