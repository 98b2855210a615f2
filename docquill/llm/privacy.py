r"""Personal data: base patterns, and information-theoretic sanitisation of the words around them.

Base spans are e-mail addresses, IP addresses, card and phone numbers; their patterns here are linear-time
forms (look-behind, possessive repeats) that match exactly as the plain ones do.

The values found are the protected entities. Over the whole corpus the number of documents with a term,
with an entity and with both give the pointwise mutual information of term and entity. Divided by the
entity's own information, log2(N / n(e)), it says which share of the entity a term reveals. P(entity | term) is
smoothed by ``SMOOTH`` documents in which the entity is as frequent as everywhere, so one or two documents
count as evidence, but as less than many. A term at or over ``REMOVE`` is removed from documents that hold
the entity, one at or over ``GENERALISE`` is generalised. Everything runs on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.llm.common import result, saved, shared_dir

LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
TERM = r"\p{L}"
SMOOTH, REMOVE, GENERALISE, RUN = 1.0, 0.95, 0.8, 256
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "removed": "", "general": "<TERM>"}

_SPAN = "array<struct<start: bigint, stop: bigint, value: string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    back = F.reverse(_digits(x))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(13, 19), _luhn(x)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def matches(text: Column, pattern: Column) -> Column:
    """All matches with code-point positions: the pieces between matches give the distances.

    Positions are summed up in runs of RUN matches, and over the runs, so many matches in one text don't cost their square.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zero = F.lit(0).cast("bigint")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        return F.struct(stop.alias("at"), F.array_append(state["spans"], F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"))).alias("spans"))

    def runs(pairs: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / RUN).cast("int")), lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN)))
        return _let(each, lambda own: _let(F.transform(own, lambda r: F.aggregate(r, zero, lambda t, x: t + F.length(x["gap"]) + F.length(x["value"]))), lambda long: F.flatten(F.transform(own, lambda r, k: one(r, F.aggregate(F.slice(long, F.lit(1), k), zero, lambda t, n: t + n))))))

    def one(pairs: Column, at: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans")), step)["spans"]

    return _let(F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull()), runs)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["value"]))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["value"])))


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a column of (start, stop, value) for each kind; the input must not have columns of those names."""
    none = F.array().cast(_SPAN)
    text = F.col(text_col)
    for kind, pattern in PATTERNS.items():
        hint = HINTS[kind]
        may = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9](?:[ -]?[0-9]){12}")
        if kind == "ip":
            may = text.rlike(PATTERNS["ip"])
        docs = docs.withColumn(kind, F.coalesce(F.when(may, _checked(kind, matches(text, F.lit(pattern)))), none))
    return docs


def terms_of(text: Column) -> Column:
    """Distinct lower-case terms, runs of letters, outside e-mail addresses."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    words = F.split(F.lower(plain), rf"[^{TERM}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def classes_of(held: DataFrame) -> DataFrame:
    """held (id, entity) with ne, the number of documents of the entity, and class: entities of the same documents share one.

    A class is known by ne and 128 bits over its documents' ids. Terms can't tell its entities apart, so each counts once.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"x{k}") for k in range(2)]
    entity = held.groupBy("entity").agg(F.count(F.lit(1)).alias("ne"), *marks)
    return held.join(entity.select("entity", "ne", F.struct("ne", "x0", "x1").alias("class")), "entity")


def disclosing_terms(rows: DataFrame, text: DataFrame, work: str, smooth: float = SMOOTH, generalise: float = GENERALISE) -> DataFrame:
    """(id, term, share): for each document that holds entities, its terms that reveal at least ``generalise`` of one, and the most.

    rows: (id, entities, text) of the documents that hold any; text: (id, text) of all documents.
    A term can only reach ``generalise`` while few documents hold it: P(entity | term) is at most ne * (1 + smooth / N) /
    (nt + smooth) and must reach (ne / N) ** (1 - generalise). So terms that are too frequent for all entities of a
    document go before any pair of an entity and a term is made.
    """
    n = float(max(1, text.count()))
    held = rows.select("id", F.explode(F.array_distinct("entities")).alias("entity")).distinct()
    held = saved(classes_of(held).select("id", "class", "ne").distinct(), f"{work}/held")
    enough = lambda ne: ne * (1 + smooth / F.lit(n)) * F.pow(F.lit(n) / ne, F.lit(1 - generalise)) * (1 + 1e-9) - smooth  # the most nt
    bound = held.groupBy("id").agg(F.max("ne").alias("ne")).select("id", enough(F.col("ne")).alias("most"))
    near = rows.join(bound, "id").select("id", "most", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    near = saved(near, f"{work}/near")
    wanted = near.groupBy("term").agg(F.max("most").alias("most"))
    # terms of all texts are counted where they are found; only those that a holder has, and that stay rare enough, go on
    every = text.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("nt"))
    every = saved(every.join(wanted, "term").where("nt <= most").select("term", "nt"), f"{work}/every")
    rare = near.join(every, "term").where("nt <= most").select("id", "term", "nt")
    met = held.join(rare, "id").where(F.col("nt") <= enough(F.col("ne")))
    both = met.groupBy("class", "term").agg(F.count(F.lit(1)).alias("both"), F.first("ne").alias("ne"), F.first("nt").alias("nt"))
    info = F.log2(F.lit(n) / F.col("ne"))
    likely = (F.col("both") + smooth * F.col("ne") / F.lit(n)) / (F.col("nt") + smooth)  # P(entity | term)
    share = F.when(info > 0, F.log2(likely * F.lit(n) / F.col("ne")) / info)
    telling = both.select("class", "term", share.alias("share")).where(F.col("share") >= generalise)
    return held.select("id", "class").join(telling, "class").groupBy("id", "term").agg(F.max("share").alias("share"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smooth: float = SMOOTH, remove_at: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """One row per row of docs: id, email, ip, card, phone, term: arrays of (start, stop, value).

    Positions are code points, stop exclusive; a term's value says ``removed`` or ``general``. Every
    entity counts, however few documents hold it. A null text is empty. Rows that repeat an id each
    get their own base spans and the terms of all of them; a row without an id gets base spans only.
    Term spans never overlap base spans. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = list(PATTERNS)
    entities = F.concat(*map(_named, kinds))
    # the few texts that hold anything are kept, so that later joins never move all texts
    base = with_base_spans(text).withColumn("entities", entities)
    base = saved(base.withColumn("text", F.when((F.size("entities") > 0) & F.col("id").isNotNull(), F.col("text"))), f"{work}/base")
    holders = base.where("text is not null").select("id", "entities", "text")
    telling = disclosing_terms(holders, text, work, smooth, generalise)
    own = saved(telling.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares")), f"{work}/own")  # terms of one document
    with_terms = holders.join(own, "id")
    alternatives = F.array_join(F.array_sort(F.map_keys("shares"), lambda a, b: F.length(b) - F.length(a)), "|")
    pattern = F.concat(F.lit(rf"(?iu)(?<!{TERM})(?:"), alternatives, F.lit(rf")(?!{TERM})"))
    spans = F.filter(matches(F.col("text"), pattern), lambda x: F.try_element_at("shares", F.lower(x["value"])).isNotNull())
    kind = lambda x: F.when(F.element_at("shares", F.lower(x["value"])) >= remove_at, "removed").otherwise("general")
    term = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), kind(x).alias("value")))
    term = with_terms.select("id", F.xxhash64("text").alias("h"), term.alias("term")).dropDuplicates(["id", "h"])
    taken = F.concat(*(F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))) for k in kinds))
    out = base.withColumn("h", F.xxhash64("text")).join(term, ["id", "h"], "left").withColumn("taken", taken)
    free = F.filter(F.coalesce("term", F.array().cast(_SPAN)), lambda t: ~F.exists("taken", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return result(out.select(F.col("id").alias(id_col), *kinds, free.alias("term")), work)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with spans (start, stop, kind) replaced by their masks; of overlapping ones the first, then longest, counts."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]).cast("int"))

    def step(s: Column, x: Column) -> Column:
        mask = F.lit("")
        for kind, m in MASKS.items():
            mask = F.when(x["kind"] == kind, m).otherwise(mask)
        take = x["start"] >= s["at"]
        add = F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), mask)
        return F.struct(F.when(take, x["stop"]).otherwise(s["at"]).alias("at"), F.when(take, add).otherwise(s["out"]).alias("out"))

    end = F.aggregate(order, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step)
    return F.concat(end["out"], F.substring(text, (end["at"] + 1).cast("int"), F.length(text)))
