"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct shingles of ``SHINGLE`` words, lower-cased (A-Z), words being ``[^\\x20\\x09-\\x0D]+``; with
fewer words, the whole text is one. Two texts link when 100 |A & B| >= 75 |A | B|. So their sets differ in at most
(|A| + |B|) / 7 shingles, and the smaller has at least 3/4 of the larger's size.

The parity sketch of a set XORs one bit for each shingle into a very wide, sparse bit vector; the Hamming distance of two
sketches is at most the size of the sets' symmetric difference. By size bands (powers of two), sketches are cut in pieces,
more than they may differ in, so that some pieces of linked texts agree. Pieces are ordered for all
texts alike, those of several shingles first: as at most D pieces differ, the first D + 1 of both texts have one in common,
and only these are joined. Texts near the upper end of a band also stand in the next one. Texts that meet in a piece are
verified: first by folded sketches of a few bits for each shingle, which every task can hold, then on their whole sets.

Equal sets are one node from the start, so copies never form pairs. In a piece that many different
sets share, all are compared with a few centres at first. Those left in other components are then compared sketch by sketch, in blocks:
for some rounds, while components grow together, only the nearest set of another component is
verified, and at last all that may link and still are in different components. So no link between different texts is lost, and groups of near copies cost one comparison
for each text and piece.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockledger.llm.common import fresh, id_and_text, mixed, offsets_of, record, runs, written
from stockledger.llm.components import components

SHINGLE = 5
CROWD = 16  # different sets in a piece, beyond which they are compared with centres first
BLOCK = 2048  # members of a crowded piece in one block
ROUNDS = 4  # in which members of crowded pieces are compared with the nearest of another component only
FEW = 10  # pairs given for each link, beyond which these rounds are over
FIRST = 8  # of its crowded pieces that go with a member, to tell pairs that meet elsewhere too
AT_ONCE = 1 << 18  # pairs of sketches in one step of a comparison
BROADCAST_IDS = 2_000_000  # 16 MB

SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.binary())]
)
PIECES = pa.schema([("piece", pa.int64()), ("n", pa.int32()), ("d1", pa.int64())])
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("piece", pa.int64())])
HASHES = pa.schema([("id", pa.int64()), ("hashes", pa.binary())])
VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; on short arrays much faster than the table of values that ``np.unique`` makes."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    split = [t.lower().split() for t in texts]
    words_at = offsets_of([len(ws) for ws in split]).tolist()
    words = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), dtype=np.uint64, count=words_at[-1])
    joined = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + mixed(words[k : k + len(joined)] + np.uint64(k + 1))
    joined = mixed(joined)
    out = []
    for a, b in zip(words_at, words_at[1:], strict=False):
        if b - a >= size:
            out.append(distinct(joined[a : b - size + 1]))
        elif b > a:
            out.append(np.asarray([xxhash.xxh64_intdigest(words[a:b].tobytes(), seed=int(b - a))], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def digest(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist())


def folded_sketch(hashes: np.ndarray) -> bytes:
    """The parity sketch with its bits folded on at least twice as many as there are shingles, a power of two."""
    size = max(256, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 256
    odd = np.bincount((mixed(hashes) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch folded on to ``size`` bytes: halves are XORed, which keeps every parity right."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def may_link(n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, whose sketches differ in so many bits at least, can link."""
    return (7 * distance <= n + m) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))


def n_pieces(high: int) -> int:
    """Pieces of a sketch in the band of sizes below ``high``."""
    return max(-(-2 * high // 5), min(2 * high, 64))


def pieces(hashes: np.ndarray) -> np.ndarray:
    """Keys of the pieces by which a set must be found: for each of its bands, the first D + 1."""
    n = len(hashes)
    spread = mixed(hashes)
    largest, band = 4 * n // 3, n.bit_length()
    found = []
    for high, top in ((1 << band, min(largest, (1 << band) - 1)), (2 << band, largest)):
        differ = (n + top) // 7
        if differ == 0 or top < high >> 1:
            continue  # equal sets only, or no set of that band is close enough
        count = n_pieces(high)
        at = ((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(first, n)).astype(np.uint64)
        parity = np.bitwise_xor.reduceat(spread, first)
        key = mixed(parity + (at[first] << np.uint64(40)) + (size << np.uint64(20)) + np.uint64(high))
        rank = (key >> np.uint64(1)) | ((size == 1).astype(np.uint64) << np.uint64(63))
        if len(key) > differ + 1:
            key = key[np.argpartition(rank, differ)[: differ + 1]]
        elif len(key) <= differ:
            # Too few pieces hold anything: empty ones, in order, make up the number.
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), at[first])[: differ + 1 - len(key)]
            key = np.concatenate([key, mixed((empty << np.uint64(40)) + np.uint64(high))])
        found.append(key)
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)


def described(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): size, digest and folded sketch of the shingle set of each row."""

    def run(batches):
        for ids, part in runs(batches):
            sets = shingle_sets(part, size)
            both = [digest(s) for s in sets]
            sketches = [folded_sketch(s) for s in sets]
            yield record(SETS, ids, [len(s) for s in sets], [d[0] for d in both], [d[1] for d in both], sketches)

    return texts.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch binary")


def piece_rows(texts: DataFrame, size: int = SHINGLE, remembered: int = 500_000) -> DataFrame:
    """(piece, n, d1) of every set; a task gives those of equal sets once, as long as it remembers them."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for _, part in runs(batches):
            keys, sizes, nodes = [], [], []
            for hashes in shingle_sets(part, size):
                node = digest(hashes)
                if len(hashes) and node not in seen:
                    if len(seen) < remembered:
                        seen.add(node)
                    own = pieces(hashes)
                    keys.append(own)
                    sizes.append(np.full(len(own), len(hashes), dtype=np.int32))
                    nodes.append(np.full(len(own), node[0], dtype=np.int64))
            if keys:
                yield record(PIECES, np.concatenate(keys), np.concatenate(sizes), np.concatenate(nodes))

    return texts.mapInArrow(run, "piece long, n int, d1 long")


def _close(smaller, larger):
    return 4 * smaller >= 3 * larger


def meeting(rows: DataFrame) -> DataFrame:
    """(a, b, piece) of nodes that share a piece and may be close in size.

    Up to ``CROWD`` different nodes give all pairs, without their piece. More give (centre, node, piece) for every node, a new
    centre beginning where sizes become too large for the last; a centre stands with itself.
    """

    def run(batches):
        members: list[tuple[int, int]] = []  # different nodes of the piece at hand, in order of size
        piece, centre = None, None
        a, b, of = [], [], []

        def put(x: int, y: int, p: int | None) -> None:
            a.append(x)
            b.append(y)
            of.append(p)

        def join_centre(n: int, node: int) -> None:
            nonlocal centre
            if centre is None or not _close(centre[0], n):
                centre = (n, node)
            put(centre[1], node, piece)

        def end_piece() -> None:
            if centre is None:
                for i, (n, x) in enumerate(members):
                    for m, y in members[i + 1 :]:
                        if not _close(n, m):
                            break
                        put(min(x, y), max(x, y), None)

        def flush():
            pairs = list(dict.fromkeys(zip(a, b, of, strict=True)))
            a.clear(), b.clear(), of.clear()
            return record(MET, *map(list, zip(*pairs, strict=True))) if pairs else None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n, nodes = (batch.column(i).to_numpy() for i in range(3))
            new = np.concatenate([[piece is None or keys[0] != piece], keys[1:] != keys[:-1]])
            starts = np.flatnonzero(new)
            ends = np.append(starts, len(keys))
            spans = [(0, int(ends[0]), False)] if not new[0] else []
            # A piece of one row meets nobody, unless it goes on in the next batch.
            wanted = (np.diff(ends) > 1) | (ends[1:] == len(keys))
            spans += [(int(s), int(e), True) for s, e in zip(starts[wanted], ends[1:][wanted], strict=True)]
            for start, end, fresh in spans:
                if fresh:
                    end_piece()
                    members.clear()
                    piece, centre = keys[start].item(), None
                for m, node in zip(n[start:end].tolist(), nodes[start:end].tolist(), strict=True):
                    if members and members[-1] == (m, node):
                        continue
                    if centre is not None:
                        join_centre(m, node)
                        members[-1] = (m, node)
                        continue
                    members.append((m, node))
                    if len(members) > CROWD:
                        for size, other in members:
                            join_centre(size, other)
                        del members[:-1]
            if len(a) > 50_000 and (out := flush()) is not None:
                yield out
        end_piece()
        if (out := flush()) is not None:
            yield out

    dealt = rows.repartition(F.col("piece")).sortWithinPartitions("piece", "n", "d1")
    return dealt.mapInArrow(run, "a long, b long, piece long")


def with_hashes(texts: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, hashes) of the rows of ``texts`` with an id in ``wanted``: few ids go to all tasks, more are joined."""

    def run(batches):
        for ids, part in runs(batches):
            yield record(HASHES, ids, [s.tobytes() for s in shingle_sets(part, size)])

    small = wanted.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(wanted) if small else wanted, "id", "left_semi")
    return found.mapInArrow(run, "id long, hashes binary")


def alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes that may link by size and sketch."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            distance = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y))
                size = min(len(x), len(y))
                distance[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            keep = pa.array(may_link(n, m, distance))
            yield record(VERIFIED, batch.column(0).filter(keep), batch.column(1).filter(keep))

    side = lambda name: sketches.select(
        F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("sketch").alias(f"{name}_sketch")
    )
    given = pairs.join(side("a"), "a").join(side("b"), "b")
    return given.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Those pairs (a, b) of ids of ``texts`` of which the whole sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both) and both > 0)
            yield record(VERIFIED, batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)))

    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    hashes = written(with_hashes(texts, wanted, size).dropDuplicates(["id"]), "hashes")
    side = lambda name: hashes.select(F.col("id").alias(name), F.col("hashes").alias(f"{name}_hashes"))
    given = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_hashes", "b_hashes")
    return given.mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``; component_id is the smallest id reachable by links.

    Null, empty and wordless texts have no shingles and no links. A row without an id links by an equal set only. Rows that share
    an id are one document.
    """
    texts = id_and_text(docs, id_col, text_col)
    sets = written(described(texts, size), "sets")
    # Nodes: one for each different set, named by its smallest document.
    nodes = written(sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "nodes")
    named = sets.join(nodes.where("node IS NOT NULL"), ["d1", "d2"]).where("doc_id = node")
    named = written(named.select("d1", "node", "n", "sketch").dropDuplicates(["node"]), "named")
    met = written(meeting(piece_rows(texts, size)), "met")
    # d1 alone names a set in the shuffle; should sets share it, all of them stand for it, and meet each other.
    left = named.select(F.col("d1").alias("a"), F.col("node").alias("x"))
    right = named.select(F.col("d1").alias("b"), F.col("node").alias("y"))
    pair = lambda found: found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pair(met.select("a", "b").distinct().join(left, "a").join(right, "b"))
    twins = pair(left.join(right, F.col("a") == F.col("b")))
    pairs = written(alike(pairs.unionByName(twins).distinct(), named), "pairs")
    links = written(verified(pairs, texts, size), "links")
    crowds = met.where("piece IS NOT NULL").select("piece", F.col("b").alias("d1")).distinct()
    crowds = written(crowds.join(named.select("d1", "node", "n"), "d1").drop("d1"), "crowds")
    cards = written(with_first_pieces(crowds, named), "cards")
    last = False
    for turn in range(ROUNDS + 1):
        groups, last = components(links), last or turn == ROUNDS
        given = written(across(crowds, cards, groups, nearest=not last).distinct(), "across")
        found = written(verified(given, texts, size), "links")
        if found.isEmpty() and not last:
            last, given = True, written(across(crowds, cards, groups, nearest=False).distinct(), "across")
            found = written(verified(given, texts, size), "links")
        links = links.unionByName(found)
        if last:
            groups = groups if found.isEmpty() else components(links)
            break
        # Where hardly any pair links, components have grown together, and what is left is compared as a whole.
        last = found.count() * FEW < given.count()
    owner = sets.drop("sketch").join(nodes, ["d1", "d2"], "left")
    groups = groups.withColumnRenamed("node", "of")
    return owner.join(groups, F.col("node") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id")
    )


def with_first_pieces(crowds: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, sketch, first) of the nodes of crowded pieces; ``first`` has the least ``FIRST`` of a node's crowded pieces, or -1 for lack of them."""
    least = F.sort_array(F.collect_set("piece"))
    lack = F.array_repeat(F.lit(-1).cast("long"), FIRST)
    first = crowds.groupBy(F.col("node").alias("of")).agg(F.slice(F.concat(least, lack), 1, FIRST).alias("first"))
    return sketches.select("node", "sketch").join(first, F.col("node") == F.col("of")).drop("of")


def met_before(first: np.ndarray, x: np.ndarray, y: np.ndarray, piece: int) -> np.ndarray:
    """Whether nodes ``x`` and ``y`` are known, by their first pieces, to share one below ``piece``."""
    found = np.zeros(len(x), dtype=bool)
    for k in range(first.shape[1]):
        own = first[x, k]
        # -1 stands for lack of pieces; should it be the key of one, a pair may be given twice.
        found |= (own < piece) & (own != -1) & (first[y] == own[:, None]).any(axis=1)
    return found


def across(crowds: DataFrame, cards: DataFrame, groups: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of a crowded piece (piece, node, n) that are in different components and may link.

    Pieces within one component are done with. Of the others, members are dealt in blocks, and every two blocks of a piece
    are compared in a task of their own. Near copies share very many pieces; a pair is left to the least of them, as far as the first pieces
    of its nodes tell, so it is not given again for each, but may be given twice. With ``nearest`` each member gives one pair at most for a block it is compared
    with: that of the smallest distance.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: pa.Table) -> np.ndarray:
        piece, i, j = (rows.column(k)[0].as_py() for k in range(3))
        block, node, n, component = (rows.column(k).to_numpy() for k in range(3, 7))
        sketch = [np.frombuffer(s.as_buffer(), dtype=np.uint8) for s in rows.column(7)]
        size = min(map(len, sketch))
        bits = np.stack([folded(s, size) for s in sketch]).view(np.uint64).T.copy()
        first = rows.column(8).combine_chunks().flatten().to_numpy().reshape(-1, FIRST)
        group, sevenths = np.unique(component, return_inverse=True)[1].astype(np.int32), n.astype(np.int32)
        here, there = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        step = max(1, AT_ONCE // max(1, len(there)))
        for at in range(0, len(here), step):
            x = here[at : at + step]
            distance = np.zeros((len(x), len(there)), dtype=np.int32)
            for word in bits:
                distance += np.bitwise_count(word[x, None] ^ word[there])
            distance *= 7
            able = distance <= sevenths[x, None] + sevenths[there]
            able &= group[x, None] != group[there]
            if i == j and not nearest:
                able &= there > x[:, None]
            row, column = np.nonzero(able)
            new = may_link(n[x[row]], n[there[column]], distance[row, column] // 7)
            new &= ~met_before(first, x[row], there[column], piece)
            row, column = row[new], column[new]
            if nearest:
                order = np.lexsort((distance[row, column], row))
                row, column = row[order], column[order]
                best = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
                row, column = row[best], column[best]
            found.append(np.column_stack([node[x[row]], node[there[column]]]))
        return np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), dtype=np.int64)

    def run(batches):
        key, parts = None, []

        def done():
            return record(schema, *np.unique(compare(pa.Table.from_batches(parts)), axis=0).T)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                own = tuple(keys[start].tolist())
                if own != key:
                    if parts:
                        yield done()
                    key, parts = own, []
                parts.append(batch.slice(start, end - start))
        if parts:
            yield done()

    groups = groups.withColumnRenamed("node", "of")
    known = crowds.join(groups, F.col("node") == F.col("of"), "left").drop("of")
    known = known.withColumn("component", F.coalesce("component", "node"))
    open_ = known.groupBy("piece").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    )
    open_ = open_.where("low < high").drop("low", "high")
    dealt = known.join(open_, "piece").join(cards, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "piece", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "component", "sketch", "first"
    )
    dealt = dealt.repartition("piece", "i", "j").sortWithinPartitions("piece", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def representatives(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, without those that belong to a group of another, smaller id.

    Of each group the document with the smallest id stays. Rows without an id stay.
    """
    gone, of = linked(docs, size, id_col, text_col).where("doc_id <> component_id"), fresh("of")
    gone = written(gone.select(F.col("doc_id").alias(of)), "gone")
    return docs.join(gone, docs[id_col] == F.col(of), "left_anti")

