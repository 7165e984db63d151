"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target number of words, and so each of its documents the same expected number of copies. The whole
part of it is taken as it is. The fraction is rounded to 0 or 1 so that the words taken hardly vary: two documents with
fractions meet, and words move at random from one to the other until one of the two has a whole number of copies. The
probabilities are such that every document keeps its expected copies, and no meeting changes the number of words.

Meetings run through a reduction tree. Documents of a source are hashed into blocks of about ``FAN`` rows; a block is
folded to decided documents and at most one that is left over, and the left-overs of ``FAN`` blocks make a block of the
next level. A source of n documents takes log(n)/log(FAN) levels, none of which gathers more than a block. One
document of each source is left at the root, so its words taken differ from the target by less than that document's size.

Randomness is a hash of the ids that meet, so reruns agree. Defined results: a null text has size 0; documents of size 0
take the whole part only; a null source is a source, the last one; repeated rows are documents of their own; if all texts
are empty all targets are 0; an empty table gives an empty result. Other columns come through ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.session import cut, table

FAN = 64
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row for each source: ``src, source, n_docs, source_size, target``.

    Targets fill like water: level times weight, but ``most`` times the source's size at most. With sources in the order
    of the level at which they fill up, each has a candidate level from what the ones before it leave; the first source that
    does not fill up at its candidate level has the common level. The table has a row for each source, not for each document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    of = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    of = of.withColumn("src", (F.row_number().over(by_name) - 1).cast("int"))
    of = of.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("src") % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    of = of.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    common = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("src")))).over(everything)
    cap = F.col("cap").cast("double")
    return of.withColumn("target", F.coalesce(F.least(cap, common * F.col("w")), cap)).select("src", "source", "n_docs", "source_size", "target")


def _chance(*of: Column) -> Column:
    """Uniform in [0, 1) from the values given."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11).cast("double") * F.lit(2.0**-53)


def _let(values: list[tuple[str, Column]], then) -> Column:
    """``then`` of a struct of named values, each computed once."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values])), then), 1)


ITEM = "struct<order:bigint,doc_id:bigint,mark:bigint,nth:int,size:bigint,words:double>"
#: What tells one row from another: the id, a hash of the text, and a number among rows that agree in both.
ROW = ["doc_id", "mark", "nth", "size"]
DONE = "array<struct<doc_id:bigint,mark:bigint,nth:int,size:bigint,up:int>>"
STATE = f"struct<held:{ITEM},done:{DONE}>"


def _meet(state: Column, x: Column) -> Column:
    """The document held so far meets ``x``; words move from one to the other until one of them is whole."""
    c = state["held"]
    item = lambda it, words: F.struct(*[it[c].alias(c) for c in ("order", *ROW)], words.alias("words"))
    decided = lambda it, up: F.struct(*[it[c].alias(c) for c in ROW], up.cast("int").alias("up"))
    none = F.lit(None).cast(ITEM)

    def move(v: Column) -> Column:
        gain, loss = F.least(v["room"], x["words"]), F.least(c["words"], v["x_room"])
        return _let([("in", v["chance"] * (gain + loss) < loss), ("gain", gain), ("loss", loss), ("room", v["room"]), ("x_room", v["x_room"])], settle)

    def settle(m: Column) -> Column:
        c_done = F.when(m["in"], m["room"] <= x["words"]).otherwise(c["words"] <= m["x_room"])
        x_done = F.when(m["in"], x["words"] <= m["room"]).otherwise(m["x_room"] <= c["words"])
        held = F.when(c_done & x_done, none).when(c_done, item(x, F.when(m["in"], x["words"] - m["gain"]).otherwise(x["words"] + m["loss"]))).otherwise(item(c, F.when(m["in"], c["words"] + m["gain"]).otherwise(c["words"] - m["loss"])))
        done = F.when(c_done & x_done, F.array(decided(c, m["in"]), decided(x, ~m["in"]))).when(c_done, F.array(decided(c, m["in"]))).otherwise(F.array(decided(x, ~m["in"])))
        return F.struct(held.alias("held"), F.concat(state["done"], done).alias("done"))

    met = _let([("room", c["size"] - c["words"]), ("x_room", x["size"] - x["words"]), ("chance", _chance(c["order"], x["order"]))], move)
    return F.when(c.isNull(), F.struct(x.alias("held"), state["done"].alias("done"))).otherwise(met).cast(STATE)


def rounded(items: DataFrame, most_docs: int, fan: int = FAN) -> DataFrame:
    """``src, doc_id, mark, nth, size, up`` from ``src, doc_id, mark, nth, size, words, n_docs``: up is 1 with probability words / size."""
    out = []
    level = items.withColumn("n", F.ceil(F.col("n_docs") / fan)).withColumn("order", F.xxhash64(F.lit(SEED), "src", *ROW))
    level = level.withColumn("block", F.pmod(F.xxhash64("order", F.lit(SEED)), F.col("n")))
    blocks = -(-most_docs // fan)
    while True:
        packed = level.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("order", *ROW, "words").cast(ITEM))).alias("items"))
        start = F.struct(F.lit(None).cast(ITEM).alias("held"), F.array().cast(DONE).alias("done")).cast(STATE)
        folded = cut(packed.select("src", "block", F.aggregate("items", start, _meet).alias("state")))
        out.append(folded.select("src", F.inline("state.done")))
        left = folded.where("state.held IS NOT NULL").select("src", F.expr(f"block div {fan}").alias("block"), "state.held.*")
        if blocks <= 1:
            last = (_chance(F.col("order")) * F.col("size") < F.col("words")).cast("int")
            out.append(left.select("src", *ROW, last.alias("up")))
            break
        level, blocks = left, -(-blocks // fan)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, fan: int = FAN) -> DataFrame:
    """``doc_id, source, mark, size, source_size, target, copies, taken`` for each row of ``docs`` (doc_id, source, text); mark is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.xxhash64("text").alias("mark"), word_count(F.col("text")).alias("size"))
    # rows that agree in all are counted before they meet, and then numbered: no block gathers the rows of one id
    rows = cut(rows.groupBy("doc_id", "source", "mark", "size").agg(F.count("*").alias("n")))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    sources = source_targets(rows, weights, share, most)
    part = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = cut(sources.withColumn("whole", F.floor(part).cast("int")).withColumn("part", part - F.floor(part)))
    known = sources.select("src", "n_docs", "part", F.col("source").alias("of"))
    tagged = rows.join(known, rows["source"].eqNullSafe(known["of"]))
    open_ = (F.col("size") > 0) & (F.col("part") > 0)
    items = tagged.where(open_).select("src", "n_docs", *ROW, (F.col("part") * F.col("size")).alias("words"))
    up = rounded(items, sources.agg(F.max("n_docs")).first()[0] or 0, fan)
    up = up.unionByName(tagged.where(~open_).select("src", *ROW, F.lit(0).alias("up")))
    out = up.join(sources, "src").withColumn("copies", F.col("whole") + F.col("up"))
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _row_key(doc_id: Column, source: Column, mark: Column) -> list[Column]:
    """Equality of these is equality of id, source and text, nulls included."""
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("of"), mark.alias("mark")]


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it has copies, with all of its columns, whatever their names."""
    key = ["no_id", "id", "no_source", "of", "mark"]
    copies = mix_copies(docs, **how).select(*_row_key(F.col("doc_id"), F.col("source"), F.col("mark")), "copies")
    copies = copies.groupBy(*key).agg(F.sort_array(F.collect_list("copies")).alias("copies"))
    rows = docs.select(F.struct("*").alias("row"))  # no other name can clash with the columns of docs
    rows = rows.select(*_row_key(F.col("row.doc_id"), F.col("row.source"), F.xxhash64("row.text")), "row")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    taken = rows.join(copies, key).withColumn("taken", F.element_at("copies", F.col("nth"))).where("taken > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("taken")))).select("row.*")


def op5_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op5_pivotal_mixing": op5_pivotal_mixing}
ORACLES: dict[str, str] = {}
