"""Instrument search and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import settle

# fixed values: favourites always offered for these words
FAVOURITES = (
    ("NIFTY 50", "Nifty 50 Index (Spot)", "index", ("NIFTY",)),
    ("NIFTY OPTIONS", "Nifty Options ATM Premium", "options", ("OPT", "NIFTY")),
)
RESERVED = tuple(f[0] for f in FAVOURITES)


def search(instruments: DataFrame, query: str, kind: str = "all", limit: int = 20, all_words: bool = False) -> DataFrame:
    """First ``limit`` instruments of a kind (file order) whose search key holds ``query`` or all its words; reserved names are left out first."""
    words = query.upper().split() if all_words else [query.upper()]
    hit = F.lit(True)
    for word in words:
        hit = hit & F.col("search_symbol").contains(word)
    typed = instruments.withColumn("type", F.when(F.col("instrument_name") == "EQUITY", "stock").otherwise("index"))
    found = typed.where(hit & ~F.col("search_symbol").isin(*RESERVED))
    if kind not in ("", "all"):
        found = found.where(F.col("type") == kind)
    return found.orderBy("position").limit(limit)


def search_with_favourites(instruments: DataFrame, query: str, kind: str = "all", limit: int = 20) -> DataFrame:
    """Fixed favourites that match the query, then the search hits."""
    q = query.upper()
    chosen = [(n, d, t) for n, d, t, words in FAVOURITES if q == "" or any(w in q for w in words)]
    schema = "symbol string, description string, type string"
    fixed = instruments.sparkSession.createDataFrame(chosen, schema)
    hits = search(instruments, query, kind, limit).select(F.col("search_symbol").alias("symbol"), "description", "type")
    return fixed.unionByName(hits.join(fixed, "symbol", "left_anti"))


def rank_search(instruments: DataFrame, query: str, exchange: str = "", kind: str = "", limit: int = 30) -> DataFrame:
    """Weight is the position in the name, else 8000 plus the position in the description; best first."""
    q = query.upper()
    out = instruments
    if kind:
        out = out.where(F.col("type") == kind)
    if exchange:
        out = out.where(F.col("exchange") == exchange)
    in_name = F.instr(F.upper("name"), q) - 1
    in_text = F.instr(F.upper("description"), q) - 1
    if q:
        out = out.where((in_name >= 0) | (in_text >= 0))
    weight = F.when(in_name >= 0, in_name).otherwise(8000 + in_text) if q else F.lit(0)
    ranked = out.withColumn("weight", weight).orderBy("weight", "position").limit(limit)
    return ranked.select(
        F.col("name").alias("symbol"),
        F.concat("exchange", F.lit(":"), "name").alias("full_name"),
        "description",
        "exchange",
        "type",
        "weight",
    )


#: Characters of an indexed run; shorter words are looked up by themselves.
GRAM = 3


def _runs(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


#: Rows of a run's list that one task meets; longer lists are cut into slices.
SLICE_ROWS = 1 << 16

#: Longest word that is looked up whole, as a run of its own length.
WORD = 10

#: Words that every task may be given, to leave other runs out before it orders them; with more words all runs are ordered.
SENT_WORDS = 1 << 18


def _posted(rows: DataFrame, texts: list[str], grams: DataFrame) -> DataFrame:
    """Rows of ``rows`` for each run in one of ``texts``, in ``_gram``; runs of the lengths that occur in the ``_gram`` of ``grams``, which are few."""
    sized = rows.join(F.broadcast(grams.agg(F.collect_set(F.length("_gram")).alias("_sizes"))))
    runs = lambda text: F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length(text)), lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(_runs(F.col(text), n))))
    return sized.withColumn("_gram", F.explode(F.array_distinct(F.concat(*[runs(t) for t in texts])))).drop("_sizes")


def _met_by_word(rows: DataFrame, texts: list[str], wanted: DataFrame, weight: Column, filters: dict[str, str], limit: int) -> DataFrame:
    """Rows next to the requests of ``wanted`` whose one word stands in one of ``texts``: of each word the first ``limit`` by ``weight`` and ``_head``, for each value that a filter may ask for.

    Tasks cut their lists to those before the exchange, so what is exchanged of a word does not grow with its list.
    """
    asked = wanted.withColumn("_gram", F.coalesce(F.get("words", F.lit(0)), F.lit("")))
    needed = settle(asked.select("_gram").distinct())
    postings = _posted(rows, texts, needed)
    if needed.count() <= SENT_WORDS:
        postings = postings.join(F.broadcast(needed), "_gram", "left_semi")
    used = asked.agg(*[F.coalesce(F.max(F.col(f) != ""), F.lit(False)).alias(f"_used{f}") for f in filters])
    apart = {f"_by{f}": F.when(F.col(f"_used{f}"), F.col(trait)) for f, trait in filters.items()}
    weighed = postings.withColumn("words", F.array("_gram")).withColumn("_weight", weight).drop("words")
    weighed = weighed.join(F.broadcast(used)).withColumns(apart).drop(*used.columns)
    kept = _first(weighed, limit, ["_gram", *apart], "_weight", "_head").select("_gram", *rows.columns)
    return asked.join(kept, "_gram").drop("_gram")


def _met_by_rarest_run(rows: DataFrame, texts: list[str], wanted: DataFrame) -> DataFrame:
    """Rows next to the requests of ``wanted`` whose rarest run of characters stands in one of ``texts``.

    Only runs that some word has are kept in the index, and of a request's runs the rarest alone is joined.
    The list of a frequent run is cut into slices, each of which meets all requests for that run, so no task holds a whole list.
    """
    size = lambda word: F.least(F.length(word), F.lit(GRAM))
    cut = F.array_distinct(F.flatten(F.transform("words", lambda w: F.when(w == "", F.array(F.lit(""))).otherwise(_runs(w, size(w))))))
    wishes = settle(wanted.select("words", F.explode(cut).alias("_gram")).distinct())
    needed = wishes.select("_gram").distinct()
    postings = settle(_posted(rows, texts, needed).join(needed, "_gram", "left_semi"))
    counts = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct("_gram", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_best")
    rarest = wishes.join(counts, "_gram", "left").groupBy("words").agg(best).where("_best._n > 0")
    rarest = settle(rarest.select("words", "_best._gram", F.ceil(F.col("_best._n") / SLICE_ROWS).cast("int").alias("_slices")))
    lists = postings.join(rarest.select("_gram", "_slices").distinct(), "_gram").withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), "_slices").cast("int"))
    asked = wanted.join(rarest, "words").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return asked.join(lists.drop("_slices"), ["_gram", "_slice"]).drop("_gram", "_slice")


def _candidates(rows: DataFrame, texts: list[str], wanted: DataFrame, weight: Column, filters: dict[str, str], limit: int) -> DataFrame:
    """Rows of ``rows`` next to each row of ``wanted`` that they may answer, none of its first ``limit`` by ``weight`` and ``_head`` left out.

    ``wanted`` has an array ``words``, all of which a hit must hold in one of the upper-case ``texts``; its columns ``filters`` ask for a value of a column of ``rows``, if not empty.
    A request of one word takes that word's first rows; several words, and words of more than ``WORD`` characters, take all rows of their rarest run.
    """
    short = (F.size("words") <= 1) & (F.coalesce(F.length(F.get("words", F.lit(0))), F.lit(0)) <= WORD)
    one, more = wanted.where(short), wanted.where(~short)
    met = _met_by_word(rows, texts, one, weight, filters, limit)
    return met if more.isEmpty() else met.unionByName(_met_by_rarest_run(rows, texts, more))


def _first(rows: DataFrame, limit: int, keys: list[str], *order: str, place: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each key, with their place; tasks keep no more of theirs before the exchange."""
    ranked = rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(place) <= limit)


def _answers(rows: DataFrame, texts: list[str], traits: list[str], requests: DataFrame, hit: Column, weight: Column, filters: dict[str, str], limit: int) -> DataFrame:
    """The first ``limit`` of ``rows`` by ``weight`` and position for each ``request_id``, with ``_weight, rank``; the other columns of ``requests`` say what is asked for.

    ``hit`` (of the words) and ``weight`` read those columns and the ``traits`` of a row, ``filters`` names a trait for each column of ``requests`` that asks for its value, if not empty.
    So rows of equal traits are one class: none but its first ``limit`` can be in an answer, and an answer lies in the first ``limit`` classes by weight and first position.
    Equal requests are answered once.
    """
    asked = settle(requests)
    keys = [c for c in requests.columns if c != "request_id"]
    wanted = settle(asked.select(*keys).distinct())
    members = settle(_first(rows.withColumn("_class", F.struct(*traits)), limit, ["_class"], "position", place="_member"))
    classes = members.where("_member = 1").select(F.col("position").alias("_head"), *[F.col(f"_class.{t}").alias(t) for t in traits])
    for filter_, trait in filters.items():
        hit = hit & ((F.col(filter_) == "") | (F.col(filter_) == F.col(trait)))
    met = _candidates(classes, texts, wanted, weight, filters, limit).where(hit).withColumns({"_weight": weight, "_class": F.struct(*traits)})
    nearest = _first(met, limit, keys, "_weight", "_head").select(*keys, "_class", "_weight")
    found = _first(nearest.join(members, "_class"), limit, keys, "_weight", "position").drop("rank")
    return _first(asked.join(found, keys), limit, ["request_id"], "_weight", "position").select("request_id", *rows.columns, "_weight", "rank")


def search_requests(instruments: DataFrame, requests: DataFrame, limit: int = 20) -> DataFrame:
    """``search`` for a table of requests ``request_id, query, kind, all_words`` at once: the instruments with ``request_id, rank``.

    All requests share one index of character runs over the search keys. An empty query matches every instrument; a null query or kind counts as empty.
    """
    typed = instruments.withColumn("type", F.when(F.col("instrument_name") == "EQUITY", "stock").otherwise("index"))
    query = F.upper(F.coalesce("query", F.lit("")))
    words = F.when(F.col("all_words"), F.filter(F.split(query, r"\s+"), lambda w: w != "")).otherwise(F.array(query))
    wanted = requests.select("request_id", words.alias("words"), F.when(F.col("kind") != "all", F.col("kind")).otherwise("").alias("_kind"))
    hit = F.forall("words", lambda w: F.col("search_symbol").contains(w))
    named = typed.where(~F.col("search_symbol").isin(*RESERVED))
    return _answers(named, ["search_symbol"], ["search_symbol", "type"], wanted, hit, F.lit(0), {"_kind": "type"}, limit).drop("_weight")


def favourites_requests(instruments: DataFrame, requests: DataFrame, limit: int = 20) -> DataFrame:
    """``search_with_favourites`` for a table of requests: ``request_id, rank, symbol, description, type``, favourites first."""
    requests = settle(requests)
    q = F.upper(F.coalesce("query", F.lit("")))
    offered = F.array_compact(
        F.array(
            *[
                F.when(
                    (q == "") | F.exists(F.array(*[F.lit(w) for w in words]), lambda w: q.contains(w)),
                    F.struct(F.lit(n).alias("symbol"), F.lit(d).alias("description"), F.lit(t).alias("type")),
                )
                for n, d, t, words in FAVOURITES
            ]
        )
    )
    fixed = requests.select("request_id", F.posexplode(offered).alias("_place", "_f")).select("request_id", F.col("_place").cast("long").alias("_place"), "_f.*")
    hits = search_requests(instruments, requests.withColumn("all_words", F.lit(False)), limit)
    hits = hits.select("request_id", (F.col("rank") + len(FAVOURITES)).cast("long").alias("_place"), F.col("search_symbol").alias("symbol"), "description", "type")
    both = fixed.unionByName(hits.join(fixed.select("request_id", "symbol"), ["request_id", "symbol"], "left_anti"))
    place = Window.partitionBy("request_id").orderBy("_place")
    return both.select("request_id", F.row_number().over(place).alias("rank"), "symbol", "description", "type")


def rank_requests(instruments: DataFrame, requests: DataFrame, limit: int = 30) -> DataFrame:
    """``rank_search`` for a table of requests ``request_id, query, exchange, kind``, with ``request_id, rank``; empty or null filters pass all."""
    q = F.upper(F.coalesce("query", F.lit("")))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    wanted = requests.select("request_id", F.array(q).alias("words"), empty("exchange").alias("_exchange"), empty("kind").alias("_kind"))
    rows = instruments.withColumns({"_name": F.upper("name"), "_text": F.upper("description")})
    word = F.get("words", F.lit(0))
    in_name, in_text = F.instr(F.col("_name"), word) - 1, F.instr(F.col("_text"), word) - 1
    weight = F.when(word == "", 0).when(in_name >= 0, in_name).otherwise(8000 + in_text)
    hit = (in_name >= 0) | (in_text >= 0) | (word == "")
    filters = {"_exchange": "exchange", "_kind": "type"}
    ranked = _answers(rows, ["_name", "_text"], ["_name", "_text", "exchange", "type"], wanted, hit, weight, filters, limit).withColumnRenamed("_weight", "weight")
    return ranked.select(
        "request_id", "rank", F.col("name").alias("symbol"), F.concat("exchange", F.lit(":"), "name").alias("full_name"), "description", "exchange", "type", "weight"
    )


def lookup_instrument(instruments: DataFrame, symbol: str) -> DataFrame:
    """First instrument with exactly this search key, with the request segment."""
    index = F.col("instrument_name") == "INDEX"
    return (
        instruments.where(F.col("search_symbol") == symbol.upper())
        .orderBy("position")
        .limit(1)
        .withColumns(
            {
                "segment": F.when(index, "IDX_I").otherwise("NSE_EQ"),
                "instrument": F.when(index, "INDEX").otherwise("EQUITY"),
            }
        )
    )


def expiries(instruments: DataFrame, prefix: str, excluded: tuple[str, ...] = (), kind: str | None = None) -> DataFrame:
    """Distinct sorted expiry dates of the instruments of an underlying."""
    keep = F.col("search_symbol").startswith(prefix)
    for word in excluded:
        keep = keep & ~F.col("search_symbol").contains(word)
    if kind is not None:
        keep = keep & (F.col("instrument_name") == kind)
    day = F.substring_index(F.col("expiry").cast("string"), " ", 1)
    return instruments.where(keep).select(day.alias("expiry")).distinct().orderBy("expiry")
