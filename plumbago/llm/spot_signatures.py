"""Document fingerprints by SpotSigs, in DataFrame functions only.

A signature is a common word (the anchor) with the chain of content words that follow it: from each
run of common words the last is the anchor, and the next ``chain`` content words, common words
skipped, form the chain; the start of a text counts as one more anchor, so that any text with a word
has a signature. The set of 64-bit signature hashes is the fingerprint. Likeness is the Jaccard
similarity of two sets. Joins deal sets into partitions by their size, such that only neighbouring
partitions can reach the threshold, meet at the rarest signatures of a set (a prefix long enough
that two similar sets must share one) and are pruned by size before sets are compared.

Defined cases: null and empty texts have an empty fingerprint, alike to each other (1) and unlike
any other (0); repeated rows have equal fingerprints; null ids sort first; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.llm.common import materialise, parts_for

#: Common words of four languages that serve as anchors.
ANCHORS = tuple(sorted(set(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how good"
    " le la les de des du et un une que qui en est pour dans par sur au aux pas elle il ne se ce plus son avec"
    " der die das und nicht von ist den des dem mit sich auf für als auch ein eine im zu es an werden aus er hat dass sie nach wird bei noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich"
    " el los las una y del con no su al lo como más pero sus este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos"
    .split()
)))
START = "^"


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression (a lambda variable is not evaluated again where it is used)."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, chain: int = 3) -> Column:
    """Sorted distinct signature hashes of a text."""
    words = F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")

    def content(w: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            before = F.get(w, i - 1)
            anchor = F.when(i == 0, F.lit(START)).when(before.isin(*ANCHORS), before)
            return F.when(~x.isin(*ANCHORS) & (x != ""), F.struct(x.alias("w"), anchor.alias("a")))

        return F.filter(F.transform(w, mark), lambda m: m.isNotNull())

    def spots(c: Column) -> Column:
        def spot(m: Column, i: Column) -> Column:
            follow = [F.coalesce(F.get(c, i + k)["w"], F.lit("")) for k in range(1, chain)]
            return F.when(m["a"].isNotNull() | (i == 0), F.xxhash64(F.coalesce(m["a"], F.lit(START)), m["w"], *follow))

        found = F.filter(F.transform(c, spot), lambda h: h.isNotNull())
        return found

    # a text of common words only keeps its words as one signature
    plain = lambda w: F.when((F.size(w) > 0) & (w[0] != ""), F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return _let(words, lambda w: _let(_let(content(w), spots), lambda s: F.array_sort(F.array_distinct(F.when(F.size(s) > 0, s).otherwise(plain(w))))))


def as_text(spots: Column) -> Column:
    """A fingerprint as a string: the sorted hashes, 16 hex digits each."""
    return F.lower(F.array_join(F.transform(spots, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity; 0 without comparing sets whose sizes rule out ``least``. Two empty sets are alike."""
    na, nb = F.size(a), F.size(b)
    bound = F.least(na, nb) / F.greatest(na, nb, F.lit(1))
    exact = _let(F.size(F.array_intersect(a, b)), lambda both: both / (na + nb - both))
    return F.when((na == 0) & (nb == 0), 1.0).when((bound == 0) | (bound < least), 0.0).otherwise(exact)


#: At most this many ranges of ids on each of two levels: both levels' cuts together stay below 9 MB.
RANGES = 1024


def _cuts(parts: int) -> Column:
    return F.array(*[F.lit(i / parts) for i in range(1, parts)])


def _place(key: Column, cuts: Column) -> Column:
    """How many of the sorted cuts are not above the key: its range."""
    return F.size(F.filter(cuts, lambda c: c <= key))


def id_ranges(docs: DataFrame, key: str, rows_each: int) -> tuple[DataFrame, int]:
    """Adds ``range``, ascending with the key, of about ``rows_each`` rows; and how many ranges there can be.

    Cuts are quantiles of all keys, on two levels, so that far or dense ids spread like any others. Beyond
    ``RANGES`` squared ranges their rows grow instead. Rows with one key share a range.
    """
    n = docs.count()
    wide = min(RANGES, parts_for(parts_for(n, rows_each) ** 0.5, 1))
    deep = min(RANGES, parts_for(n, rows_each * wide))
    if wide == 1 and deep == 1:
        return docs.withColumn("range", F.lit(0).cast("long")), 1
    outer = (docs.agg(F.percentile_approx(key, _cuts(wide), 20 * wide).alias("cuts")).first()["cuts"] or []) if wide > 1 else []
    docs = docs.withColumn("outer", _place(F.col(key), F.array(*[F.lit(c).cast("long") for c in outer]).cast("array<bigint>")))
    if deep == 1:
        return docs.withColumn("range", F.col("outer").cast("long")).drop("outer"), wide
    # materialised: quantile sketches may differ between runs, and each row needs one range in all plans
    inner = materialise(docs.groupBy("outer").agg(F.percentile_approx(key, _cuts(deep), 20 * deep).alias("cuts")), "cuts")
    placed = docs.join(F.broadcast(inner), "outer")  # at most RANGES rows of RANGES cuts
    return placed.withColumn("range", F.col("outer").cast("long") * deep + _place(F.col(key), F.col("cuts"))).drop("outer", "cuts"), wide * deep


def with_next(df: DataFrame, id_col: str, text_col: str, chain: int = 3, rows_each: int = 256) -> DataFrame:
    """Rows (doc_id, text, own, next_text, after): the next text by ascending id, after the last the first,
    with the signatures of both.

    Ids are cut into ranges of about ``rows_each`` rows by quantiles, and each range also gets the first
    row of the next that has any, so no sort spans the table. The search for those next ranges is over
    range numbers, in groups of the square root of their count.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs, ranges = id_ranges(docs, "key", rows_each)
    heads = docs.groupBy("range").agg(F.min("key").alias("head"))
    groups = max(1, int(ranges**0.5))
    heads = materialise(heads.withColumn("group", F.expr(f"div(range, {groups}L)")), "heads")
    firsts = heads.groupBy("group").agg(F.min("range").alias("first_range")).withColumn("follows", F.lag("group").over(Window.orderBy("group")))
    inside = heads.select("range", "head", F.lag("range").over(Window.partitionBy("group").orderBy("range")).alias("previous"), "group")
    last = heads.groupBy("group").agg(F.max("range").alias("last_range"))
    edge = firsts.join(last.select(F.col("group").alias("follows"), "last_range"), "follows").select(F.col("first_range").alias("range"), "last_range")
    top = heads.agg(F.max("range").alias("top_range"))
    wrap = heads.join(F.broadcast(heads.agg(F.min("range").alias("range"))), "range").join(F.broadcast(top)).select("head", F.col("top_range").alias("to"))  # one row each
    copies = inside.join(edge, "range", "left").select("head", F.coalesce("previous", "last_range").alias("to")).where("to is not null").union(wrap)
    own = docs.select("range", F.lit(0).alias("copy"), "key", "doc_id", "text")
    lent = docs.join(materialise(copies, "copies"), F.col("key") == F.col("head"))
    # the least text of a key, without sorting the key's texts
    lent = lent.groupBy("to", "key").agg(F.min("text").alias("text")).select(F.col("to").alias("range"), F.lit(1).alias("copy"), "key", F.lit(None).cast("long").alias("doc_id"), "text")
    # each text's signatures are taken once, behind the exchange, and handed to the row before
    rows = own.union(lent).repartition("range").withColumn("own", signatures(F.col("text"), chain))
    ordered = Window.partitionBy("range").orderBy("copy", "key", "text")
    following = [F.lead("text").over(ordered).alias("next_text"), F.lead("own").over(ordered).alias("after")]
    return rows.select("copy", "doc_id", "text", "own", *following).where("copy = 0").drop("copy")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter (rounded down) replaced by as many first code points of the next."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next text's."""
    rows = with_next(df, id_col, text_col, chain).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    marked = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        "own", signatures(F.col("edit"), chain).alias("changed"), "after",
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("changed")).alias("near_edited"), jaccard(F.col("own"), F.col("after")).alias("near_next"),
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 3) -> DataFrame:
    """Rows (class_a, class_b, likeness) between different sets of at least ``threshold``, and membership by ``classes``.

    A class is a distinct set, named by its least doc_id. Returned rows hold both class ids.
    """
    sets = materialise(classes(df, id_col, text_col, chain).groupBy("class_id").agg(F.first("spots").alias("spots")), "spot-sets")
    parts = sets.where(F.size("spots") > 0).select("class_id", "spots", F.size("spots").alias("n"), F.floor(F.log(1 / threshold, F.size("spots")) + 1e-9).alias("part"))
    postings = parts.select("class_id", "n", "part", F.explode("spots").alias("spot"))
    counts = postings.groupBy("spot").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = postings.join(counts, "spot").withColumn("at", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "spot")))
    held = Window.partitionBy("class_id")
    # spots of one set only can't be shared: of the prefix n - ceil(t n) + 1 they take places first
    shared = ranked.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(held))
    prefix = shared.where(F.col("at") + F.col("alone") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("class_id", "n", "part", "spot")
    other = prefix.select(F.col("class_id").alias("class_b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "spot")
    near = prefix.withColumnRenamed("class_id", "class_a").join(other, ["spot", "part"])
    near = near.where((F.least("n", "nb") >= F.lit(threshold) * F.greatest("n", "nb") - 1e-9) & ((F.col("n") > F.col("nb")) | (F.col("n") == F.col("nb")) & (F.col("class_a") < F.col("class_b")) ))
    pairs = near.select("class_a", "class_b").distinct()
    both = pairs.join(sets.select(F.col("class_id").alias("class_a"), F.col("spots").alias("a")), "class_a").join(sets.select(F.col("class_id").alias("class_b"), F.col("spots").alias("b")), "class_b")
    return both.select("class_a", "class_b", jaccard(F.col("a"), F.col("b"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = 3) -> DataFrame:
    """Rows (doc_id, spots, class_id): documents with equal fingerprints share the least doc_id as class."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), signatures(F.col(text_col), chain).alias("spots"))
    docs = materialise(docs.withColumn("mark", F.sha2(as_text(F.col("spots")), 256)), "spots")
    named = docs.groupBy("mark").agg(F.min("doc_id").alias("class_id"))
    return docs.join(named, "mark").select("doc_id", "spots", "class_id")
