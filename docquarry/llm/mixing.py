"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source gets a budget of tokens at its root. Going down, each node deals its budget to its
children by weight; a child gets at most what its leaves hold, and what it can't use goes to its siblings by their
weights. As a node never gets more than its leaves hold, siblings take up a shortage before it can reach an ancestor.
A leaf then takes its budget from its documents in seeded orders, one order for each epoch: all of as many epochs as fit,
and of the next one the shortest prefix that reaches the budget (so each leaf may exceed it by less than one document).

Everything is integer arithmetic in DataFrame operations. The place of a document in an order is a hash of its id and text.
Where a prefix ends is found in rounds: sums over 256 ranges of what is open of each leaf, then of the range where the
prefix ends, and at last of single places. So no leaf is ever sorted or held whole, and taking a document needs no more
than to compare its place with the end of its leaf, where it lies. Only rows at that very place, which are copies of one
document, are counted out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, numbered_copies, written

# production parameters: weights of the children of a node, and the domain of each source
DOMAINS = {"web": [f"src{i}" for i in range(10)], "books": [f"src{i}" for i in range(10, 15)], "reference": [f"src{i}" for i in range(15, 20)]}
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "reference": 2}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 3}
#: Share of all tokens that the mixture takes: (numerator, denominator).
SHARE = (3, 5)
SEED = 17
#: Rounds that narrow down where a prefix ends, and hexadecimal digits of the place that each adds: 16 ** 2 ranges.
ROUNDS, DIGITS = 3, 2
#: Plans of up to so many leaves are broadcast (some 100 bytes each); larger ones are joined by shuffling.
BROADCAST_LEAVES = 20_000

_LEVELS = ["domain", "lang", "source"]
_WHOLE = "decimal(38,0)"


def _weight(of: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(of == name, F.lit(weight)).otherwise(out)
    return out


def domain_of(source: Column, domains: dict[str, list[str]]) -> Column:
    out = F.lit("other")
    for name, sources in domains.items():
        out = F.when(source.isin(sources), F.lit(name)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0b\f\r]+")), F.lit(0)).cast("long")


def _dealt(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent columns, name, cap, weight, given) with share: what each node gets of its parent's given."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    filling = family.orderBy(F.col("cap") / F.col("weight"), name)
    whole = lambda x: F.coalesce(x, F.lit(0)).cast(_WHOLE)
    nodes = nodes.withColumn("_left", F.col("given").cast(_WHOLE) - whole(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1))))
    nodes = nodes.withColumn("_open", whole(F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))))
    # in this order, those that can be filled come first
    nodes = nodes.withColumn("_full", F.col("cap").cast("decimal(20,0)") * F.col("_open").cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * F.col("_left").cast("decimal(20,0)"))
    rest = F.col("given").cast(_WHOLE) - whole(F.sum(F.when(F.col("_full"), F.col("cap"))).over(family))
    open_ = whole(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(family))
    part = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("cast(div(cast(weight as decimal(18,0)) * cast(_rest as decimal(20,0)), cast(_all as decimal(18,0))) as bigint)"))
    nodes = nodes.withColumn("_rest", rest).withColumn("_all", F.when(open_ == 0, F.lit(1)).otherwise(open_)).withColumn("_part", part)
    # tokens lost in rounding down go one each to the first by name
    odd = F.col("_rest") - whole(F.sum(F.when(~F.col("_full"), F.col("_part"))).over(family))
    turn = F.sum(F.when(~F.col("_full"), 1).otherwise(0)).over(family.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    nodes = nodes.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(F.col("_part") + F.when(turn <= odd, 1).otherwise(0)).cast("long"))
    return nodes.drop("_left", "_open", "_full", "_rest", "_all", "_part")


def plan(leaves: DataFrame, share: tuple[int, int], epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf from leaves (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANGUAGE_WEIGHTS, "source": SOURCE_WEIGHTS}
    tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget, above = min(tokens * share[0] // share[1], tokens * epochs), None
    for depth, level in enumerate(_LEVELS):
        parent, own = _LEVELS[:depth], _LEVELS[: depth + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(F.col(level), weights[level]))
        nodes = nodes.join(above, parent) if parent else nodes.withColumn("given", F.lit(budget).cast("long"))
        above = _dealt(nodes, parent, level).select(*own, "tokens", F.col("share").alias("given"))
        if depth < 2:
            above = above.drop("tokens")
    return above.withColumnRenamed("given", "budget")


def _place(seed: int) -> Column:
    """32 hexadecimal digits: the place of a document (doc_id, digest) in the order of epoch `last`."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("last").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("digest")))


def _leaf(documents: DataFrame, *more: Column) -> DataFrame:
    """domain, lang, source, doc_id and a digest of the text of each row, and more."""
    source = F.coalesce("source", F.lit("(none)"))
    digest = F.coalesce(F.md5(F.encode("text", "utf-8")), F.lit("-"))
    return documents.select(domain_of(source, DOMAINS).alias("domain"), F.coalesce("lang", F.lit("(none)")).alias("lang"), source.alias("source"), F.col("doc_id").alias("doc_id"), digest.alias("digest"), *more)


def _ends(counted: DataFrame, plans: DataFrame, sent, seed: int) -> DataFrame:
    """(leaf, cut, take): of epoch `last`, a leaf takes all documents before place cut, and `take` of the rows at it."""
    open_ = plans.where("rest > 0").select(*_LEVELS, "last", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    places = counted.join(sent(open_.select(*_LEVELS, "last")), _LEVELS).withColumn("place", _place(seed)).drop("last")
    ahead = lambda by: F.sum("sum").over(Window.partitionBy(*_LEVELS).orderBy(by)) - F.col("sum")
    for turn in range(1, ROUNDS + 1):
        inside = places.join(sent(open_), _LEVELS).where(F.startswith("place", F.col("prefix")))
        sums = inside.groupBy(*_LEVELS, "last", "rest", "before", F.substring("place", 1, DIGITS * turn).alias("prefix")).agg(F.sum("n_tokens").alias("sum"))
        found = sums.withColumn("before", F.col("before") + ahead("prefix")).where("before < rest and before + sum >= rest")
        after = written(found.select(*_LEVELS, "last", "rest", "prefix", "before"))
        if turn > 1:
            dropped(open_)
        open_ = after
    # rows at one place are copies of one document
    inside = places.join(sent(open_), _LEVELS).where(F.startswith("place", F.col("prefix")))
    sums = inside.groupBy(*_LEVELS, "rest", "before", "place").agg(F.sum("n_tokens").alias("sum"), F.max("n_tokens").alias("each"))
    found = sums.withColumn("before", F.col("before") + ahead("place")).where("before < rest and before + sum >= rest")
    return written(found.select(*_LEVELS, F.col("place").alias("cut"), F.expr("(rest - before + each - 1) div each").alias("take")))


def _taken(rows: DataFrame, decided: DataFrame, sent, seed: int) -> DataFrame:
    """The rows (leaf, doc_id, digest, row) that the mixture takes, with budget and epoch, one for each epoch."""
    placed = rows.join(sent(decided), _LEVELS).withColumn("place", _place(seed))
    whole = F.col("last") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0)
    before = placed.withColumn("whole", whole).where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    # copies at the very end: equal rows are counted before any meet, and as many go on as the budget takes
    equal = placed.where("place = cut").groupBy(*_LEVELS, "budget", "last", "take", F.to_json(F.struct("row")).alias("as_text")).agg(F.first("row").alias("row"), F.count("*").alias("copies"))
    ahead = F.sum("copies").over(Window.partitionBy(*_LEVELS).orderBy("as_text")) - F.col("copies")
    equal = equal.withColumn("copies", F.greatest(F.least("copies", F.col("take") - ahead), F.lit(0)).cast("long"))
    out = [*_LEVELS, "row", "budget"]
    return before.select(*out, "epoch").union(numbered_copies(equal, "copies", "copy").select(*out, F.col("last").alias("epoch")))


def _decided(documents: DataFrame, share: tuple[int, int], epochs: int, seed: int):
    """The counted documents (leaf, doc_id, digest, n_tokens), what each leaf takes, and how that is sent to rows."""
    counted = written(_leaf(documents, token_count(F.col("text")).alias("n_tokens")))
    leaves = written(counted.groupBy(*_LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    # each leaf: so many epochs whole, and of epoch `last` a prefix of `rest` tokens
    plans = plan(leaves, share, epochs).where("budget > 0").withColumn("last", F.expr("budget div tokens").cast("int")).withColumn("rest", F.expr("budget % tokens"))
    plans = written(plans)
    sent = F.broadcast if leaves.count() <= BROADCAST_LEAVES else lambda df: df
    ends = _ends(counted, plans, sent, seed)
    decided = written(plans.select(*_LEVELS, "budget", "last").join(ends, _LEVELS, "left"))
    for table in (leaves, plans, ends):
        dropped(table)
    return counted, decided, sent


def mix(documents: DataFrame, share: tuple[int, int] = SHARE, epochs: int = 1, seed: int = SEED) -> DataFrame:
    """The rows of documents (doc_id, text, lang, source, ...) that the mixture takes, as struct `row`, with domain,
    language, origin, epoch (from 0), n_tokens and budget (of the leaf); one row for each epoch that takes a document.

    A null lang or source is a leaf of its own, named (none). Null and blank texts have no tokens; a leaf without any
    tokens gets nothing. Repeated rows each count; rows without a doc_id differ by their text. Columns of documents may
    have any names: they stay inside `row`.
    """
    counted, decided, sent = _decided(documents, share, epochs, seed)
    dropped(counted)
    taken = _taken(_leaf(documents, F.struct("*").alias("row")), decided, sent, seed)
    return taken.select("row", "domain", F.col("lang").alias("language"), F.col("source").alias("origin"), "epoch", token_count(F.col("row.text")).alias("n_tokens"), "budget")


def report(documents: DataFrame, epochs: int = 2) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens and leaf_budget of each document and epoch taken; odd rows as mix()
    has them. Texts are read once."""
    counted, decided, sent = _decided(documents.select("doc_id", "text", "lang", "source"), SHARE, epochs, SEED)
    taken = _taken(counted.withColumn("row", F.struct("doc_id", "n_tokens")), decided, sent, SEED)
    return taken.select("row.doc_id", *_LEVELS, "epoch", "row.n_tokens", F.col("budget").alias("leaf_budget"))


def mixed(documents: DataFrame) -> DataFrame:
    """The rows of documents that one epoch of the mixture takes, with the columns of documents; odd rows as mix() has them."""
    return mix(documents).select("row.*")
