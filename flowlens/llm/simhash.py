"""SimHash fingerprints and search by permuted block tables, in DataFrame functions only.

A text's terms are its pairs of neighbouring words; each votes with its weight for
or against each of 64 bits, by the bits of its hash. Votes are added up in packed
form: a sum of one long counts four bits, over a stretch of at most STRETCH terms,
and the stretches' sums are then added bit by bit. Fingerprints within a small
Hamming distance are found by equality alone: of BLOCKS blocks of bits, a pair
agrees on at least BLOCKS - radius, so one of the tables keyed by so many blocks
holds both under one key.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import checkpointed, text_of

BITS, STRETCH, MOST_WEIGHT = 64, 1024, 15
BLOCKS, RADIUS = 6, 3


def _lane(h: Column, j: int) -> Column:
    """Bits 4j to 4j + 3 of a hash, 16 bits apart."""
    x = F.shiftrightunsigned(h, 4 * j) if j else h
    bit = lambda i: F.shiftleft(x.bitwiseAND(F.lit(1 << i).cast("long")), 15 * i)
    return x.bitwiseAND(F.lit(1).cast("long")).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def votes(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the fingerprint of each text, a long in ``fingerprint``; 0 without words.

    One row for each distinct value of ``keys``, which must name the text. No
    shuffle is added if ``texts`` is already partitioned by some of them.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0b\f\r]+", " ")), " ")
    pairs = texts.select(*keys, words.alias("w")).select(*keys, F.posexplode(F.arrays_zip("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("v"))).alias("at", "term"))
    a, b = F.col("term.w"), F.col("term.v")
    weight = F.when(F.length(a) > 0, F.least(F.lit(MOST_WEIGHT), F.lit(1) + F.shiftright(F.length(a) + F.coalesce(F.length(b), F.lit(0)), 2))).otherwise(0).cast("long")
    terms = pairs.select(*keys, F.shiftright("at", STRETCH.bit_length() - 1).alias("_stretch"), weight.alias("_w"), F.xxhash64(a, b).alias("_h"))
    lanes = [F.sum(_lane(F.col("_h"), j) * F.col("_w")).alias(f"_l{j}") for j in range(BITS // 4)]
    part = terms.groupBy(*keys, "_stretch").agg(F.sum("_w").alias("_w"), *lanes)
    field = lambda b: F.shiftrightunsigned(f"_l{b // 4}", 16 * (b % 4)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    sums = part.groupBy(*keys).agg(F.sum("_w").alias("_w"), *[F.sum(field(b)).alias(f"_b{b}") for b in range(BITS)])
    bits = [F.when(F.col(f"_b{b}") * 2 > F.col("_w"), F.lit((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(0).cast("long") for b in range(BITS)]
    value = bits[0]
    for bit in bits[1:]:
        value = value.bitwiseOR(bit)
    return sums.select(*keys, value.alias("fingerprint"))


def as_hex(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def _following(rows: DataFrame) -> DataFrame:
    """``rows`` (distinct doc_id and _t, and others) with next_id, next_t: the next in descending order, after the last the first.

    Range partitions keep the order; what follows a partition's last row is looked
    up among the partitions' first ones, a table of one row for each partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = [F.desc("doc_id"), F.desc("_t")]
    placed = checkpointed(rows.repartitionByRange(parts, *down).withColumn("_p", F.spark_partition_id()))
    heads = placed.groupBy("_p").agg(F.max(F.struct("doc_id", "_t")).alias("first"))
    over = Window.partitionBy(F.lit(0)).orderBy("_p")  # ``parts`` rows
    top = F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("_p", F.coalesce(F.lead("first").over(over), top).alias("then"))
    inside = F.lead(F.struct("doc_id", "_t")).over(Window.partitionBy("_p").orderBy(*down))
    found = placed.withColumn("_n", inside).join(F.broadcast(heads), "_p").withColumn("_n", F.coalesce("_n", "then"))
    return found.select(*rows.columns, F.col("_n.doc_id").alias("next_id"), F.col("_n._t").alias("next_t"))


def _both_prints(rows: DataFrame, head: Column) -> DataFrame:
    """Fingerprints of the texts of ``rows`` (doc_id, _t, text) and of the same with ``head`` for the last third."""
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), head)
    wide = rows.withColumn("edited", edited).select("doc_id", "_t", "text", "edited", F.unhex(F.sha2("edited", 256)).alias("_sha"))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    both = wide.select("doc_id", "_t", "_sha", F.explode(kinds).alias("s")).select("doc_id", "_t", "_sha", "s.kind", "s.text")
    found = votes(both, ["doc_id", "_t", "_sha", "kind"])
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("fingerprint")))
    pairs = found.groupBy("doc_id", "_t", "_sha").agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    return pairs.select("doc_id", "_t", F.lower(F.hex("_sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and that of its edited text, as longs, with their neighbours.

    The edited text has the last third of the code points replaced by as many (or
    all) first ones of the next document in descending order of doc_id, then text hash;
    after the last comes the first. Columns: doc_id, _t (the text's hash), copies,
    n_chars, next_id, next_t, edited_sha256, fingerprint, edited_fingerprint.

    Rows that repeat both id and text are one row here; ``copies`` counts them. A null
    text is empty. A row without an id has no next document: its last third is
    replaced by nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("_t", F.xxhash64("text"))
    slim = rows.select("doc_id", "_t", F.length("text").cast("long").alias("n_chars")).groupBy("doc_id", "_t", "n_chars").agg(F.count("*").alias("copies"))
    known = F.col("doc_id").isNotNull()
    order = checkpointed(_following(slim.where(known)))
    # both joins below read the texts over one exchange: the same rows, columns, keys
    named = rows.where(known)
    if not order.where("copies > 1").isEmpty():
        named = named.groupBy("doc_id", "_t").agg(F.first("text").alias("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    wanted = order.select(F.col("next_id").alias("doc_id"), F.col("next_t").alias("_t"), third.alias("_k"), F.col("doc_id").alias("_for_id"), F.col("_t").alias("_for_t"))
    heads = named.join(wanted.hint("shuffle_hash"), ["doc_id", "_t"])
    heads = heads.select(F.col("_for_id").alias("doc_id"), F.col("_for_t").alias("_t"), F.substring("text", F.lit(1), F.col("_k")).alias("head"))
    found = _both_prints(named.join(heads.hint("merge"), ["doc_id", "_t"]), F.col("head"))
    found = found.join(order.hint("merge"), ["doc_id", "_t"])
    columns = ["doc_id", "_t", "copies", "n_chars", "next_id", "next_t", "edited_sha256", "fingerprint", "edited_fingerprint"]
    nameless = rows.where(~known)
    if nameless.isEmpty():
        return found.select(*columns)
    alone = nameless.groupBy("_t").agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("doc_id", F.lit(None).cast("long"))
    sizes = alone.select("_t", "copies", F.length("text").cast("long").alias("n_chars"))
    none = F.lit(None).cast("long")
    alone = _both_prints(alone, F.lit("")).join(sizes.hint("merge"), "_t").withColumns({"next_id": none, "next_t": none})
    return found.select(*columns).unionByName(alone.select(*columns))


def _masks(blocks: int, radius: int) -> list[int]:
    """The bits of each choice of blocks - radius blocks, as signed longs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    masks = [sum(block[i] for i in some) for some in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within(queries: DataFrame, all_: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint): all distinct fingerprints within ``radius`` bits of each distinct query.

    Both inputs have a long column ``fingerprint``; nulls match nothing. Copies of a
    text share a fingerprint, so that a group of copies is one row here.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(blocks, radius)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.where("fingerprint is not null").select(F.col("fingerprint").alias(name)).distinct()
        table = distinct.select(name, F.posexplode(masks).alias("_table", "_mask"))
        return table.select(name, "_table", F.col(name).bitwiseAND(F.col("_mask")).alias("_key"))

    met = keyed(queries, "query").hint("shuffle_hash").join(keyed(all_, "fingerprint"), ["_table", "_key"])  # both sides grow
    return met.where(F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint"))) <= radius).select("query", "fingerprint").distinct()


def near_classes(found: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n, classes) of the distinct fingerprints of ``found`` where ``asked``.

    A class is all rows of one fingerprint and goes by its least doc_id. ``n`` counts the
    rows of the classes within ``radius`` bits, the own one included, and ``classes``
    lists them: at most as many as there are values within the radius (43,745 for 3).
    """
    classes = found.where("doc_id is not null").groupBy("fingerprint").agg(F.sum("copies").alias("_n"), F.min("doc_id").alias("_class"))
    met = within(found.where(asked), classes, radius).join(classes.hint("merge"), "fingerprint")
    return met.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("_n").alias("n"), F.sort_array(F.collect_list("_class")).alias("classes"))


def similar_texts(docs: DataFrame, radius: int = RADIUS, one_in: int = 50, salts: int = 16) -> DataFrame:
    """Fingerprints, likenesses and, for ids divisible by ``one_in``, near documents.

    doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (16 hex
    digits), near_edited and near_next (share of equal bits with the edited text's
    fingerprint and with the next document's), n_near: how many other documents have
    a fingerprint within ``radius`` bits, and near_classes: the least ids of the
    fingerprints within it, the own one's included, whose members are the rows that
    carry that fingerprint. Both are null for the ids not asked for.

    See ``fingerprints`` for nulls and the order of documents. Repeated rows give
    repeated rows. Texts without words have the fingerprint 0; a row without an id
    has no near_next and is near nothing; an empty table gives an empty result;
    other columns are ignored.
    """
    found = checkpointed(fingerprints(docs))
    after = found.select(F.col("doc_id").alias("next_id"), F.col("_t").alias("next_t"), F.col("fingerprint").alias("_next"))
    asked = F.coalesce(F.col("doc_id") % one_in == 0, F.lit(False))
    # a fingerprint may be that of a third of all rows: the classes are met on salted keys
    near = near_classes(found, asked, radius).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = F.xxhash64("doc_id", "_t")
    found = found.withColumn("_salt", F.when(asked, F.pmod(spread, F.lit(salts))).otherwise(-1 - F.pmod(spread, F.lit(1 << 20))).cast("int"))
    joined = found.join(after.hint("merge"), ["next_id", "next_t"], "left").join(near.hint("merge"), ["fingerprint", "_salt"], "left")
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", as_hex("fingerprint").alias("fingerprint"), as_hex("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next").alias("near_next"),
        (F.col("n") - 1).alias("n_near"), F.col("classes").alias("near_classes"),
    )
