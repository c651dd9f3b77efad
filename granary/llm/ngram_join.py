"""N-gram Jaccard join by a MinHash LSH forest (operator 2).

A document is the set of its shingles of five words. Each of `trees` prefix tries holds every document under a path of
`depth` min-hashes, one byte of each; a node of a trie is the documents whose paths begin alike. The tries stand nowhere
as trees: a shuffle sorts the entries of all documents by node, and a document's path is at hand for every length.

Matched prefixes are shortened where that can still bring something:

* At full depth documents that share a path in some tree are nearly equal; the components of these matches are tight
  groups. All pairs inside one are verified exactly, in blocks of bounded size, and are met by no shorter prefix again.
* Prefixes are then shortened until the chance that two documents of the least similarity share one in some tree reaches
  the target recall. A document that is alone there in every tree, and a node whose documents are all of one tight group,
  are done. In the others a pair belongs to the first tree it meets in, so that it is looked at once.
* Pairs whose whole signatures or sizes leave no doubt that they are less similar drop out. The rest are verified
  exactly on their shingles, in blocks of their nodes, never as rows of pairs and never for whole components: documents
  that chain through loosely similar ones bring no more work than their own nodes.

A block gives each document's number of links and a spanning forest of the links. Documents of the same text are one from
the start. Chance decides only whether a pair is met: by the target at 0.8, nearly surely above it. Hashes of shingles
have 64 bits; that two different shingles, or nodes, fall together is left out of account, as is a signature that
misses its similarity by six standard deviations.

Defined results: null text and text without words have no links and are each a class of their own; a text of fewer than
five words is one shingle; rows that repeat id and text are one document, rows that repeat an id with different texts are
documents of their own with a row each, and their texts but the first by digest go by a number of 2^62 or more where the
others' class or links are named by an id; rows without an id take no part; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import forget, join_by_key, map_groups, map_rows, shingle_hashes, stored

WORDS = 5
SIMILARITY = 0.8
TREES = 32
#: Min-hashes of a full path.
DEPTH = 16
RECALL = 0.999
#: Documents, and their shingles, in each of the two sides of a block of verification, on average.
BLOCK, BLOCK_SHINGLES = 128, 1_000_000
LINKS = "id long, links long, to long"


def level(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that two sets of this similarity share in some tree with the target chance."""
    while 1 - (1 - similarity**depth) ** trees < recall:
        if depth == 1:
            raise ValueError(f"{trees} trees can't reach a recall of {recall}")
        depth -= 1
    return depth


@functools.cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    return rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, n: int) -> bytes:
    """One byte of each of n min-hashes."""
    times, plus = _hashes(n)
    points, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(n, 2**32 - 1, np.uint32)
    room = np.empty((min(256, max(1, len(points))), n), np.uint32)
    for a in range(0, len(points), 256):
        part = points[a : a + 256]
        values = room[: len(part)]
        np.multiply(part[:, None], times, out=values)
        np.add(values, plus, out=values)
        np.minimum(least, values.min(0), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least ^ (least >> np.uint32(13))).astype(np.uint8).tobytes()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id that each id of links (id, to) reaches. Every round sends the least neighbour's label to
    all neighbours and then halves the way of labels to their own labels, until no label changes; rounds are stored,
    ids never reach the driver. Joins by a hot label are split by adaptive execution."""
    both = links.where("id <> to").select("id", "to").union(links.where("id <> to").select(F.col("to"), F.col("id"))).toDF("id", "to").distinct()
    edges = stored(both)
    labels = stored(edges.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("root")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = stored(step.join(up, "root", "left").select("id", "old", F.coalesce(F.least("up", "root"), "root").alias("root")))
        forget(labels)
        labels = step.select("id", "root")
        if not step.where("root <> old").limit(1).count():
            forget(edges)
            return labels
        labels = step


def verified(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], allowed: np.ndarray, similarity: float) -> dict:
    """Of the allowed pairs (a symmetric matrix) those that are similar: for each document their number, weighted by the
    other's size, and the least document of its tree in a spanning forest."""
    n, lengths = len(ids), np.array([len(s) for s in sets])
    order = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), lengths)
    by = np.argsort(order, kind="stable")
    order, owner = order[by], owner[by]
    new = np.concatenate(([True], order[1:] != order[:-1]))[: len(order)]
    shared = np.cumsum(new) - 1
    uses = np.bincount(shared) if len(shared) else np.zeros(0, int)
    keep = uses[shared] > 1  # a shingle of one document is in no intersection
    owner, shared = owner[keep], np.unique(shared[keep], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    width = shared.max(initial=-1) + 1
    cuts = np.searchsorted(shared, np.arange(0, width + 4096, 4096))
    for i, a in enumerate(range(0, width, 4096)):
        m = np.zeros((n, min(4096, width - a)), np.float32)
        m[owner[cuts[i] : cuts[i + 1]], shared[cuts[i] : cuts[i + 1]] - a] = 1
        common += m @ m.T
    union = lengths[:, None] + lengths[None, :] - common
    link = allowed & (common >= similarity * union - 1e-9 * union)
    np.fill_diagonal(link, False)
    root = np.arange(n)

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
        a, b = top(i), top(j)
        if a != b:
            root[b if ids[a] < ids[b] else a] = a if ids[a] < ids[b] else b
    some = np.flatnonzero(link.any(1))
    return {"id": ids[some].tolist(), "links": (link[some] * sizes[None, :]).sum(1).tolist(), "to": [int(ids[top(i)]) for i in some]}


def within(rows: pa.Table, similarity: float) -> dict:
    """Links between the two sides of a block of one group (all pairs where it has one side)."""
    ids, sides, sizes = (rows.column(c).to_numpy() for c in ("id", "side", "size"))
    allowed = np.ones((len(ids), len(ids)), bool)
    if len(set(sides.tolist())) > 1:
        allowed = sides[:, None] != sides[None, :]
    return verified(ids, sizes, [shingle_hashes(t.as_py(), WORDS) for t in rows.column("text")], allowed, similarity)


class Met:
    """The pairs of a block of a node that are of different groups, meet in no earlier tree and may be similar."""

    def __init__(self, rows: pa.Table, trees: int, depth: int, length: int, similarity: float):
        first = rows.column("tree")[0].as_py()
        self.ids = rows.column("id").to_numpy()
        n = len(self.ids)
        group, count, side = (rows.column(c).to_numpy() for c in ("root", "n", "side"))
        signs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(n, trees, depth)
        self.pairs, two = np.zeros((n, n), bool), len(set(side.tolist())) > 1
        least = similarity - 6 * math.sqrt(similarity * (1 - similarity) / (trees * depth))
        for i in range(n - 1):
            after = slice(i + 1, n)
            may = (group[after] != group[i]) & (np.minimum(count[after], count[i]) >= similarity * np.maximum(count[after], count[i]) - 1e-6)
            if two:
                may &= side[after] != side[i]
            js = np.flatnonzero(may) + i + 1
            if not len(js):
                continue
            same = signs[js] == signs[i]
            near = (same.mean((1, 2)) >= least) & ~same[:, :first, :length].all(2).any(1)
            self.pairs[i, js[near]] = True
        self.pairs |= self.pairs.T


def needed(rows: pa.Table, *how) -> dict:
    """The rows of a block that are in a pair to be verified."""
    kept = rows.filter(pa.array(Met(rows, *how).pairs.any(1)))
    return {c: kept.column(c).to_pylist() for c in ("key", "a", "b", "id", "side", "tree")}


def between(rows: pa.Table, *how) -> dict:
    met = Met(rows, *how)
    sets = [shingle_hashes(t.as_py(), WORDS) for t in rows.column("text")]
    return verified(met.ids, rows.column("size").to_numpy(), sets, met.pairs, how[-1])


def keyed(documents: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, h, text and carried columns of the rows with an id: h is the text's digest, for texts without words the id."""
    own = F.concat(F.lit("#"), F.col("doc_id").cast("long").cast("string"))
    h = F.when(F.regexp_like("text", F.lit("\\S")), F.unhex(F.sha2(F.col("text").cast("binary"), 256))).otherwise(own.cast("binary"))
    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), F.col("text").cast("string").alias("text"), *carried)


def texts_of(own: DataFrame) -> DataFrame:
    """(h, rep, size, unit) of each text of (doc_id, h): rep is the least id that has it, size the ids that have it, unit its
    own number: rep, unless another text has the same one; then texts with words, by digest, come first."""
    by = own.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    nth = F.row_number().over(W.partitionBy("rep").orderBy(F.octet_length("h") < 32, "h"))
    other = F.xxhash64("rep", "h").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    return by.withColumn("unit", F.when(nth == 1, F.col("rep")).otherwise(other))


def nodes(rows: DataFrame, trees: int, depth: int, length: int, *carried: str) -> DataFrame:
    """key of the node, tree and carried columns for each tree of rows with sig, under prefixes of this length."""
    begun = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return begun.select(F.xxhash64("tree", F.substring("sig", F.col("tree") * depth + 1, F.lit(length))).alias("key"), "tree", *carried)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Adds side, a and b to rows with blocks, the number of a group's blocks: block (a, b) holds the rows of both sides,
    so a row is there once for each other side."""
    sided = rows.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return sided.withColumn("other", other).withColumn("a", F.least("other", "side")).withColumn("b", F.greatest("other", "side")).drop("other", "blocks")


def blocks(count: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int").alias("blocks")


def same_groups(met: DataFrame, texts: DataFrame, trees: int, depth: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, root) of the tight groups, and the links inside them."""
    entries = nodes(met, trees, depth, depth, "id")
    leaders = entries.groupBy("key").agg(F.min("id").alias("to"), F.count("*").alias("many")).where("many > 1").drop("many")
    near = entries.join(leaders, "key").select("id", "to").distinct()
    # a document's links go to the least of them: itself once, and the others, which many documents share, once each
    stars = near.withColumn("least", F.min("to").over(W.partitionBy("id"))).select(F.explode(F.array(F.struct("id", F.col("least").alias("to")), F.struct(F.col("to").alias("id"), F.col("least").alias("to")))).alias("l")).select("l.*")
    groups = components(stars)
    sized = stored(met.select("id", "size", "n").join(groups, "id"))
    sizes = sized.groupBy("root").agg(F.count("*").alias("members"), blocks(F.count("*"), F.sum("n")))
    placed = in_blocks(join_by_key(sized, sizes, "root", F.col("members"), sized.count())).join(texts, "id")
    links = map_groups(placed.select("id", "root", "size", "text", "side", "a", "b"), ["root", "a", "b"], LINKS, lambda: lambda t: within(t, similarity))
    return groups, stored(links)


def other_groups(met: DataFrame, groups: DataFrame, texts: DataFrame, trees: int, depth: int, length: int, similarity: float) -> DataFrame:
    """The links between documents of different tight groups that share a prefix of this length."""
    rows = stored(met.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id")))
    entries = nodes(rows, trees, depth, length, "id", "root", "n")
    mixed = entries.groupBy("key").agg(blocks(F.count("*"), F.sum("n")), F.min("root").alias("least"), F.max("root").alias("last")).where("least <> last").select("key", "blocks")
    placed = in_blocks(entries.select("key", "tree", "id").join(mixed, "key"))
    about, how = rows.select("id", "root", "n", "size", "sig"), (trees, depth, length, similarity)
    kept = stored(map_groups(placed.join(about, "id"), ["key", "a", "b"], "key long, a int, b int, id long, side int, tree int", lambda: lambda t: needed(t, *how)))
    return stored(map_groups(kept.join(about, "id").join(texts, "id"), ["key", "a", "b"], LINKS, lambda: lambda t: between(t, *how)))


def linked_classes(documents: DataFrame, similarity: float, recall: float, trees: int, depth: int) -> DataFrame:
    """doc_id, h, rep, class_id and n_links of each document."""
    length, rows = level(similarity, recall, trees, depth), keyed(documents)
    own = stored(rows.select("doc_id", "h").distinct())
    units = stored(texts_of(own))

    def make():
        def of(batch):
            out = {x: [] for x in ("doc_id", "h", "n", "sig")}
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("text"), strict=True):
                s = shingle_hashes(t.as_py(), WORDS)
                if len(s):
                    for x, v in zip(out.values(), (i, h, len(s), signature(s, trees * depth)), strict=True):
                        x.append(v)
            return out

        return of

    firsts = units.select("h", F.col("rep").alias("doc_id"), F.col("unit").alias("id"), "size")
    signed = map_rows(rows, "doc_id long, h binary, n long, sig binary", make)
    signed = stored(signed.join(firsts, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]))
    # who is alone in every tree under the shortest prefix is done
    entries = nodes(signed, trees, depth, length, "id")
    company = entries.join(entries.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "key", "left_semi").select("id").distinct()
    met = stored(signed.join(company, "id", "left_semi"))
    texts = stored(rows.join(met.select("doc_id", "h", "id"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("id", "text"))
    groups, inside = same_groups(met, texts, trees, depth, similarity)
    made = stored(inside.union(other_groups(met, groups, texts, trees, depth, length, similarity)))
    links = made.groupBy("id").agg(F.sum("links").alias("links"))
    found = units.join(links.withColumnRenamed("id", "unit"), "unit", "left").join(components(made.select("id", "to")).withColumnRenamed("id", "unit"), "unit", "left")
    found = stored(found.select("h", "rep", "size", F.coalesce("root", "unit").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    return join_by_key(own, found, "h", F.col("size"), own.count()).select("doc_id", "h", "rep", "class_id", "n_links")


def jaccard_classes(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row for each document: doc_id, rep (least id of the same text), class_id (least id that links lead to) and
    n_links (other documents of this or a similar text)."""
    return linked_classes(documents, similarity, recall, trees, depth).drop("h")


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row of each class: of its first document by id and digest, and of rows that repeat that one the first by a hash
    of all columns. Rows without an id stay."""
    found = linked_classes(documents, similarity, recall, trees, depth)
    first = found.groupBy("class_id").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("f.doc_id", "f.h")
    rows = keyed(documents, F.struct(*documents.columns).alias("row")).drop("text").join(first, ["doc_id", "h"])
    kept = rows.groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return kept.unionByName(documents.where("doc_id is null"))


def jaccard_sql(similarity: float = SIMILARITY) -> str:
    """jaccard_classes() by comparing all texts that share a shingle, for ids that do not repeat."""
    return f"""
    WITH RECURSIVE t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
    same AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS rep,
                    CASE WHEN len(w) > 0 THEN count(*) OVER (PARTITION BY text) ELSE 1 END AS size, w FROM t),
    reps AS (SELECT doc_id AS id, size, w FROM same WHERE doc_id = rep AND len(w) > 0),
    shingles AS (SELECT DISTINCT id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS s
                 FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM reps)),
    counts AS (SELECT id, count(*) AS n FROM shingles GROUP BY 1),
    pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN counts x ON x.id = a JOIN counts y ON y.id = b WHERE c >= {similarity} * (x.n + y.n - c) - 1e-9),
    reach(id, other) AS (SELECT id, id FROM reps UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
    root AS (SELECT id, min(other) AS root FROM reach GROUP BY 1),
    degree AS (SELECT a AS id, sum(r.size) AS links FROM links JOIN reps r ON r.id = b GROUP BY 1)
    SELECT s.doc_id, s.rep, coalesce(r.root, s.rep) AS class_id, (coalesce(d.links, 0) + s.size - 1)::BIGINT AS n_links
    FROM same s LEFT JOIN root r ON r.id = s.rep LEFT JOIN degree d ON d.id = s.rep
    """
