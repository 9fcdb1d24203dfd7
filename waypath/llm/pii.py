"""Personal data: patterns, and terms that give protected values away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.llm.common import BLANKS, WORD, documents, fresh, text_key, written

#: Fixed patterns of the protected kinds, in the order of the results. Their repeats are possessive and addresses start at the
#: start of a run (or where the last match ended), which changes no match: time is linear and the stack flat on any text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to have any valid match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Words on either side of a value; share of all documents with a term that hold the value, and discounted bits of information
#: about it, from which the term gives it away.
CONTEXT, DISCLOSURE, BITS = 8, 0.5, 2.0
#: Matches that one step of the search for their places goes through.
STEP = 128
#: Bits of a sieve: 2 MB at any size.
SIEVE_BITS = 24
NO_MATCH = "cast(array() as array<struct<start:int,end:int,value:string>>)"


def located(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """array<struct<start,end,value>> of the leftmost matches that `keep` accepts, in code points.

    Matches are taken in steps, so that no array of more than STEP is copied as it grows.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), hits.alias("hit"))

    def width(p: Column) -> Column:
        return p["gap"] + F.coalesce(F.length(p["hit"]), F.lit(0))

    def step(s: Column, p: Column) -> Column:
        start, end = s["at"] + p["gap"], s["at"] + width(p)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("value")))
        kept = F.coalesce(p["hit"].isNotNull() & keep(p["hit"]), F.lit(False))  # the array is copied for kept matches only
        return F.struct(end.alias("at"), F.when(kept, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    def some(ps: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(ps, F.lit(1), i), F.lit(0), lambda n, p: n + width(p))
        return F.aggregate(F.slice(ps, i + 1, F.lit(STEP)), F.struct(before.alias("at"), F.expr(NO_MATCH).alias("out")), step, lambda s: s["out"])

    def all_of(ps: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ps) - 1, F.lit(STEP)), lambda i: some(ps, i)))

    return F.transform(F.array(pairs), all_of)[0]  # an array of one names the pairs, so they are made once


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))

    def add(s: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits(value)).between(16, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def spans_of(text: Column, rank: int, kind: str) -> Column:
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    found = F.when(text.rlike(HINTS[kind]), located(text, PATTERNS[kind], lambda v: valid(kind, v))).otherwise(none)
    return F.transform(found, lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """array<struct<rank,start,end,kind,value>> of all valid matches, by kind, then place."""
    return F.concat(*(spans_of(text, rank, kind) for rank, kind in enumerate(PATTERNS)))


def n_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def marks(*key: str) -> Column:
    """The two places of a key in a sieve."""
    h, mask = F.xxhash64(*key), F.lit(2**SIEVE_BITS - 1)
    return F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))


def sieve(keys: DataFrame, *key: str) -> Column:
    """A bit map of keys, as one value of 2^SIEVE_BITS bits: sieved() lets all of them pass, and few others until it fills up."""
    spark, n = keys.sparkSession, 2 ** (SIEVE_BITS - 6)
    held = keys.select(F.explode(marks(*key)).alias("p")).groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    cells = spark.range(0, n, 1, 1).join(held, "id", "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("c"))
    return written(cells.agg(F.array_sort(F.collect_list("c")).alias("c")).select(F.col("c.b").alias("bits")), "sieve").scalar()


def sieved(df: DataFrame, bits: Column, *key: str) -> DataFrame:
    name = fresh("_marks", df)
    rows = df.withColumn(name, marks(*key))
    for i in range(2):
        p = F.get(name, F.lit(i))
        rows = rows.where(F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63))) == 1)
    return rows.drop(name)


def terms_of(rows: DataFrame, bits: Column) -> DataFrame:
    """(doc_id, t, term): the distinct words of each text that pass the sieve; no other leaves its stage."""
    words = rows.select("doc_id", "t", F.explode(F.array_distinct(F.split(F.lower("text"), BLANKS))).alias("term")).where("term <> ''")
    return sieved(words, bits, "term")


def contexts(text: Column, spans: Column) -> Column:
    """array<struct<entity,words>>: of each span its kind and value, and the CONTEXT whole words, lower-cased, on either side.

    The text's words are found once; a span's place among them comes from the ends of blocks of sqrt(words), then from one block.
    """
    words = located(text, WORD, lambda v: F.lit(True))

    def blocks(w: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(w))).cast("int"))
        at = F.when(F.size(w) >= step, F.sequence(step, F.size(w), step)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.struct(w.alias("w"), step.alias("step"), F.transform(at, lambda i: F.get(w, i - 1)).alias("last"))

    def count(d: Column, test: Callable[[Column], Column]) -> Column:
        done = F.size(F.filter(d["last"], test)) * d["step"]
        return done + F.size(F.filter(F.slice(d["w"], done + 1, d["step"]), test))

    def around(d: Column, s: Column) -> Column:
        left, right = count(d, lambda q: q["end"] <= s["start"]), count(d, lambda q: q["start"] < s["end"])
        near = F.concat(F.slice(d["w"], F.greatest(F.lit(1), left - CONTEXT + 1), F.least(F.lit(CONTEXT), left)), F.slice(d["w"], right + 1, F.lit(CONTEXT)))
        return F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), F.transform(near, lambda q: F.lower(q["value"])).alias("words"))

    known = F.transform(F.transform(F.array(words), lambda w: w), blocks)
    return F.transform(known, lambda d: F.transform(spans, lambda s: around(d, s)))[0]


def disclosing_terms(rows: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, least_bits: float = BITS) -> DataFrame | None:
    """(term, entity, bits) that disclose, or None where no document has a protected value.

    rows: doc_id, t, text. found: doc_id, t, text, spans, of documents with a protected value. The pointwise
    information of a term about a value is log2(p(value | term) / p(value)), by documents. It is estimated for every value and every
    term beside it, from the first document on, and discounted for little evidence (Pantel and Lin): times w / (w + 1), of the w
    distinct windows that the two share (copies of one window count once), times m / (m + 1), of the lesser of their document counts.
    Only candidates (terms beside a value) are counted in the corpus, and of these only terms in few enough documents are paired.
    """
    one = found.select("doc_id", "t", F.explode(contexts(F.col("text"), F.col("spans"))).alias("c"))
    window = written(one.select("doc_id", "t", "c.entity", "c.words"), "windows").withColumn("w", F.xxhash64("words"))
    if window.isEmpty():
        return None
    holding = window.select("entity", "doc_id", "t").distinct()
    by_entity = written(holding.groupBy("entity").agg(F.count("*").alias("n_entity")), "entities")
    pairs = window.dropDuplicates(["entity", "w"]).select("entity", F.explode(F.array_distinct("words")).alias("term"))
    pairs = written(pairs.groupBy("entity", "term").agg(F.count("*").alias("windows")).join(by_entity, "entity"), "pairs")
    candidates = written(pairs.groupBy("term").agg(F.max("n_entity").alias("most")), "candidates")
    by_term = terms_of(rows, sieve(candidates, "term")).groupBy("term").agg(F.count("*").alias("n_term")).join(candidates, "term")
    possible = written(by_term.where(F.col("most") >= disclosure * F.col("n_term")).drop("most"), "possible")  # no more documents hold both
    pairs = sieved(pairs, sieve(possible, "term"), "term").join(possible, "term").where(F.col("n_entity") >= disclosure * F.col("n_term"))
    pairs = written(pairs, "pairs")
    own = terms_of(found, sieve(pairs, "term"))
    both = own.join(pairs.select("term", "entity"), "term").join(holding.withColumnsRenamed({"doc_id": "_d", "t": "_t", "entity": "_e"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")) & (F.col("entity") == F.col("_e")), "left_semi")
    both = both.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    m = F.least("n_term", "n_entity")
    bits = F.log2(F.col("n_both") * F.lit(float(rows.count())) / (F.col("n_term") * F.col("n_entity"))) * F.col("windows") / (F.col("windows") + 1) * m / (m + 1)
    scored = pairs.join(both, ["entity", "term"]).where(F.col("n_both") >= disclosure * F.col("n_term"))
    return scored.select("term", "entity", bits.alias("bits")).where(F.col("bits") >= least_bits)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, t, base, terms): spans of protected values, and of terms that disclose one, in code points.

    docs needs doc_id and text; other columns are ignored, whatever their names. base: array<struct<rank,start,end,kind,value>>;
    terms: array<struct<start,end,value>> (null without any): every whole word, lower-cased, for which disclosing_terms finds a
    value. t is a hash of the text. Null and empty texts have no spans; rows stay, repeated ones too and each with its own spans; an
    empty table gives an empty result.
    """
    rows = docs.select("doc_id", text_key().alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<struct<rank:int,start:int,end:int,kind:string,value:string>>)")
    spans = rows.withColumn("base", F.when(F.col("text").contains("@") | F.col("text").rlike("[0-9]"), base_spans(F.col("text"))).otherwise(none))
    base = written(spans.select("doc_id", "t", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "base")
    found = base.where("text is not null").select("doc_id", "t", "text", F.col("base").alias("spans"))
    scored = disclosing_terms(rows, found)
    telling = None if scored is None else written(scored.select("term").distinct(), "telling")
    base = base.drop("text")
    if telling is None or telling.isEmpty():
        return base.withColumn("terms", F.expr(f"cast(null as {NO_MATCH.split(' as ')[1][:-1]})"))
    bits = sieve(telling, "term")
    own = terms_of(rows, bits).join(telling, "term", "left_semi")
    held = sieved(rows, sieve(own.select("doc_id", "t"), "doc_id", "t"), "doc_id", "t")
    words = sieved(held.select("doc_id", "t", F.explode(located(F.col("text"), WORD, lambda v: F.lit(True))).alias("s")).withColumn("term", F.lower("s.value")), bits, "term")
    marked = words.join(telling, "term", "left_semi").groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.array_sort(F.collect_set("s")).alias("terms"))
    return base.join(marked, base["doc_id"].eqNullSafe(marked["_d"]) & (base["t"] == marked["_t"]), "left").drop("_d", "_t")


def sanitize(docs: DataFrame) -> DataFrame:
    """docs with protected values generalised to their kind ("<email>") and disclosing terms removed from text.

    All columns stay, whatever their names; nulls, empty texts and repeated rows stay as they are.
    """
    d, k, t, base, terms = (fresh(name, docs) for name in ("_d", "_k", "_t", "_base", "_terms"))
    found = find_personal_data(docs).withColumnsRenamed({"doc_id": d, "t": k, "base": base, "terms": terms}).dropDuplicates([d, k])
    rows = docs.withColumn(t, text_key())
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found[d]) & (rows[t] == found[k]), "left")
    cuts = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("put"))), F.coalesce(F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("put"))), F.expr("cast(array() as array<struct<start:int,end:int,put:string>>)"))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s: Column, c: Column) -> Column:
        between = F.substr("text", s["at"] + 1, F.greatest(F.lit(0), c["start"] - s["at"]))
        return F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.when(c["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], F.array(between, c["put"]))).alias("out"))

    text = F.aggregate(cuts, start, step, lambda s: F.array_join(F.concat(s["out"], F.array(F.substr("text", s["at"] + 1, F.length("text")))), ""))
    return rows.withColumn("text", F.when(F.size(cuts) > 0, text).otherwise(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_personal_data of all documents: a row for each row, repeated ones alike; null and empty texts have no spans."""
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    shown = F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    terms = F.coalesce(F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))), F.array().cast("array<string>"))
    counts = [n_of(k).alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(shown, ","), 256).alias("base_sha256"), F.array_join(F.concat(shown, terms), ",").alias("spans"))
