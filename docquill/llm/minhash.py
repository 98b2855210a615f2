"""Near-duplicate documents by one-permutation MinHash, on DataFrame functions alone.

1. A text becomes its set of distinct 5-word shingles, as 64-bit hashes in ascending order.
2. Rows with equal sets collapse to one representative, the smallest id; copies are never paired.
3. One permutation fills ``BINS`` bins: the top bits of a hash name its bin, the smallest hash stays.
   An empty bin borrows from the non-empty bin that comes first in that bin's own random order
   (optimal densification: a short chain of probes, then the minimum of the order itself).
4. ``ROWS`` bins make a band, a band's hash is a bucket. At a similarity of 0.7 a pair shares none of
   the 42 buckets with probability 2e-8. Sets of up to ``SMALL`` shingles use exact prefix filtering
   instead: two sets at or over the threshold always share one of their first shingles.
5. A bucket proposes a star: each member with the smallest member. A pair whose signatures agree in too few
   bins goes at once, all others are confirmed on full sets.
6. Buckets whose members still lie in several components are settled. Those of up to ``CROWD`` members get more
   centres, until every pair in them was confirmed, refused, or made needless by a common component. Larger ones,
   of texts that share a passage, are settled by exact prefix filtering: their members' shingles, rarest first,
   make new buckets, in which a shared passage comes last and so proposes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquill.llm.common import ASCII_LOWER, ASCII_UPPER, checked_broadcast, connected_components, result, saved, shared_dir

WORDS, BINS_LOG2, ROWS, SMALL, PROBES, SALTS, BROADCAST_PAIRS = 5, 7, 3, 24, 6, 8, 200_000
AGREE, CROWD, BROADCAST_TAGS, BROADCAST_IDS = 62, 64, 100_000, 400_000
BINS = 1 << BINS_LOG2
BANDS = BINS // ROWS


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(F.coalesce(F.translate(text, ASCII_UPPER, ASCII_LOWER), F.lit("")), "[ \\t-\\r]+"), "")


def _hashes(words: Column) -> Column:
    at = lambda i, k: F.get(words, i + F.lit(k))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: F.xxhash64(*(at(i, k) for k in range(WORDS))))
    whole = F.array(F.xxhash64(words))
    none = F.array().cast("array<bigint>")
    return F.sort_array(F.array_distinct(F.when(F.size(words) >= WORDS, runs).when(F.size(words) > 0, whole).otherwise(none)))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, grams): each row's shingle hashes, distinct and ascending."""
    words = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    return words.select("id", _hashes(F.col("words")).alias("grams"))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BINS_LOG2)


def _bands(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Adds keys, the buckets of each set, and tags; grams is in ascending signed order, so bins are runs of it.

    tags hold four bits of each bin, sixteen bins to a number; null for small sets.
    """
    g = F.col("grams")
    first = F.filter(g, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(g, i - 1))))
    df = sets.withColumn("first", F.when(F.size(g) > SMALL, first))
    full = F.size("first") == BINS
    df = df.withColumn("at", F.when(~full, F.map_from_arrays(F.transform("first", _bin), F.col("first"))))
    # used twice, "at" stays a column of its own; used once, it would be built again for every bin
    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(F.col("at"), b.cast("bigint")))
    df = df.withColumn("sparse", F.when(F.col("at").isNotNull(), dense))

    def borrowed(v: Column, b: Column) -> Column:
        probes = [F.get("sparse", F.pmod(F.xxhash64(F.lit(p), b), F.lit(BINS)).cast("int")) for p in range(1, PROBES + 1)]
        best = F.array_min(F.transform("first", lambda x: F.struct(F.xxhash64(F.lit(0), b, _bin(x)).alias("o"), x.alias("x"))))
        return F.coalesce(v, *probes, best["x"])

    df = df.withColumn("dense", F.when(full, F.concat(F.slice("first", BINS // 2 + 1, BINS // 2), F.slice("first", 1, BINS // 2))).otherwise(F.transform("sparse", borrowed)))
    d = F.col("dense")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, *(F.get(d, j * ROWS + k) for k in range(ROWS))))
    pack = lambda k: F.aggregate(F.slice(d, 16 * k + 1, 16), F.lit(0).cast("bigint"), lambda t, x: F.shiftleft(t, 4).bitwiseOR(x.bitwiseAND(15)))
    tags = F.when(d.isNotNull(), F.array(*map(pack, range(BINS // 16))))
    n = F.size(g)
    prefix = n - F.ceil(n * num / den).cast("int") + 1
    # both sides of a pair must use one kind of key: a set a little over SMALL offers its prefix too
    exact = F.when((n > 0) & (n * num <= SMALL * den), F.slice(g, 1, F.greatest(prefix, F.lit(1))))
    none = F.array().cast("array<bigint>")
    keys = F.concat(F.coalesce(F.when(n > SMALL, bands), none), F.coalesce(exact, none))
    return df.withColumn("keys", F.array_distinct(keys)).withColumn("tags", tags).drop("first", "at", "sparse", "dense")


def _agreeing(a: Column, b: Column) -> Column:
    """The number of bins whose four bits agree in two tags."""
    total = F.lit(0)
    for k in range(BINS // 16):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + 16 - F.bit_count(x.bitwiseAND(0x1111111111111111))
    return total


def _likely(pairs: DataFrame, tags: DataFrame, few: bool) -> DataFrame:
    """The pairs that agree in at least ``AGREE`` of the 128 bins; pairs of a small set's prefix key, or with a small set, all pass.

    Four bits can make bins look equal, never different. A pair at a similarity of 0.7 agrees in 92 bins on average.
    """
    side = lambda c: F.broadcast(tags.select(F.col("id").alias(c), F.col("tags").alias(f"t{c}"))) if few else tags.select(F.col("id").alias(c), F.col("tags").alias(f"t{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    same = _agreeing(F.col("tu"), F.col("tv"))
    return both.where(F.col("exact") | F.col("tu").isNull() | F.col("tv").isNull() | (same >= AGREE)).select("u", "v").distinct()


def _rare_first(sets: DataFrame, ids: DataFrame, num: int, den: int, work: str) -> DataFrame:
    """Buckets (key, id, n) by prefix filtering of the sets that ids name, in ascending order of how many of them hold a shingle.

    Two sets at or over the threshold share one of their first n - ceil(n * threshold) + 1 shingles in any order that
    all use. A shingle of one set alone takes its place in the prefix, and needs no bucket.
    """
    rows = sets.join(checked_broadcast(ids), "id", "left_semi").select("id", F.size("grams").alias("n"), F.explode("grams").alias("key"))
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    common = rows.join(held, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("common"))  # of one set
    length = F.size("common") - F.ceil(F.col("n") * num / den).cast("int") + 1
    return saved(common.where(length > 0).select(F.explode(F.slice("common", F.lit(1), length)["key"]).alias("key"), "id", "n"), work)


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int, work: str) -> DataFrame:
    """The pairs (u, v) with den * intersection >= num * union, on full sets."""
    # sets are far larger than pairs: few pairs go to the sets, and only sets that a pair names are shuffled
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    a = sets.select(F.col("id").alias("u"), F.col("grams").alias("gu")).join(pairs, "u")
    named = checked_broadcast(saved(pairs.select(F.col("v").alias("id")).distinct(), work))
    both = a.join(sets.join(named, "id", "left_semi").select(F.col("id").alias("v"), F.col("grams").alias("gv")), "v")
    both = both.select("u", "v", F.size("gu").alias("nu"), F.size("gv").alias("nv"), F.size(F.array_intersect("gu", "gv")).alias("i"))
    return both.where(F.col("i") * den >= (F.col("nu") + F.col("nv") - F.col("i")) * num).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 70, den: int = 100, crowd: int = CROWD) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Links are pairs with ``den * |A & B| >= num * |A | B|``. component_id is the smallest id reachable
    over links, itself included; kept marks that smallest one. A null or blank text has no shingles
    and links with nothing. Rows that repeat an id each go with their own text; different texts with
    the same smallest id share a component. A row without an id joins nothing: its component_id is null and it is kept. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    # only the two columns needed go in; a clash with other columns of docs is thus impossible
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sets = shingle_sets(base, "id", "text")
    facts = _bands(sets, num, den)
    facts = saved(
        facts.select("id", F.size("grams").cast("bigint").alias("n"), F.xxhash64("grams").alias("h1"), F.xxhash64(F.lit("second"), "grams").alias("h2"), "keys", "tags"),
        f"{work}/facts",
    )
    usable = facts.where(F.col("id").isNotNull() & (F.col("n") > 0))
    groups = usable.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("tags").alias("tags"))
    reps = saved(groups, f"{work}/reps")
    bucket = reps.select(F.posexplode("keys").alias("pos", "key"), F.col("rep").alias("id"), "n")
    bucket = bucket.select("key", "id", "n", ((F.col("n") <= SMALL) | (F.col("pos") >= BANDS)).alias("exact"))  # prefix keys follow the bands
    shared = bucket.groupBy("key").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "v")
    bucket = saved(bucket.join(shared, "key"), f"{work}/buckets")
    members = saved(bucket.select("id").distinct(), f"{work}/members")
    many = members.count()
    members = F.broadcast(members) if many <= BROADCAST_IDS else members
    tags = saved(reps.select(F.col("rep").alias("id"), "tags").join(members, "id", "left_semi"), f"{work}/tags")
    few = many <= BROADCAST_TAGS
    rep_sets = saved(shingle_sets(base.join(members, "id", "left_semi"), "id", "text"), f"{work}/sets", "uncompressed")

    centre = bucket.where("id = v").select("key", F.col("n").alias("nv"))
    fits = F.least("n", "nv") * den >= F.greatest("n", "nv") * num
    pairs = bucket.where("id <> v").join(centre, "key").where(fits).select(F.col("id").alias("u"), "v", "exact").distinct()
    pairs = saved(_likely(pairs, tags, few), f"{work}/pairs-0")
    links = saved(_confirmed(pairs, rep_sets, num, den, f"{work}/named-0"), f"{work}/links-0")
    parts = saved(connected_components(links, f"{work}/parts-0"), f"{work}/parts-0/out")
    tested, step, done, bucket = pairs, 0, 0, bucket.select("key", "id", "n", "exact")
    while True:
        named = bucket.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("c")).where("a <> b").select("key", "c")
        named, step = named.join(split, "key"), step + 1
        if step == 1:
            named = saved(named, f"{work}/open")
            crowded = saved(named.where(F.col("c") > crowd).select("id").distinct(), f"{work}/crowded")
            named = named.where(F.col("c") <= crowd)
            if not crowded.isEmpty():
                rare = _rare_first(rep_sets, crowded, num, den, f"{work}/rare")
                rare = rare.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
                open_keys = rare.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("c")).where("a <> b").select("key", "c")
                named = named.unionByName(rare.join(open_keys, "key").withColumn("exact", F.lit(False)))
        ranked = named.drop("c").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("id")))
        ranked = saved(ranked, f"{work}/ranked-{step}")
        top = done + (1 << 3 * step)  # few rounds: each is a score of jobs
        # a bucket's largest component can hold most of it: its rows meet only centres of the others
        main = ranked.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
        ranked = saved(ranked.join(main, "key").withColumn("main", F.col("component") == F.col("main")), f"{work}/split-{step}")
        hub = ranked.where((F.col("rank") > done) & (F.col("rank") <= top)).select("key", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"), F.col("rank").alias("rv"), F.col("main").alias("mv"))
        met = ranked.where("not main").join(hub, "key").unionByName(ranked.where("main").join(hub.where("not mv"), "key"))
        more = met.where((F.col("rank") > F.col("rv")) & (F.col("component") != F.col("cv")) & fits)
        more = _likely(more.select(F.col("id").alias("u"), "v", "exact").distinct(), tags, few).join(tested, ["u", "v"], "left_anti")
        more = saved(more, f"{work}/pairs-{step}")
        left = ranked.agg(F.max("rank")).first()[0] or 0
        fresh = not more.isEmpty()
        if fresh:
            found = saved(_confirmed(more, rep_sets, num, den, f"{work}/named-{step}"), f"{work}/links-{step}")
            tested = tested.union(more)
        if fresh and not found.isEmpty():
            links = links.union(found)
            parts = saved(connected_components(links, f"{work}/parts-{step}"), f"{work}/parts-{step}/out")
        done = top
        if left <= done:
            break
        bucket = ranked.select("key", "id", "n", "exact")

    rep_part = reps.select("h1", "h2", "rep").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    # a group of copies may hold a third of all rows: its rows spread over SALTS keys
    salts = F.explode(F.array(*map(F.lit, range(SALTS))))
    rep_part = rep_part.select("h1", "h2", F.coalesce("component", "rep").alias("component"), salts.alias("salt"))
    rows = facts.select("id", "n", "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = rows.join(rep_part, ["h1", "h2", "salt"], "left")
    part = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), part).alias("component_id")
    )
    return result(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), work)
