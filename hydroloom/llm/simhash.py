"""SimHash near-dedup: 64-bit fingerprints, links at few differing bits, connected components.

Anchor points: the two 32-bit halves of a fingerprint each lose their top bit and are covered
by the perfect Hamming code of 31 bits (covering radius 1).  Two fingerprints that differ in
at most three bits differ in at most one bit of some half, so each is replicated, for each
half, to every codeword within 1 + 1 bits (16 at most); the nearest codeword is its home.  A
pair meets where one is at home, and only there it is compared, by all 64 bits.  (A code over
all 64 bits would have to cover radius + 3 bits: 9,959 anchors a fingerprint for the
63-bit Hamming code, hence the halves.)

Only distinct fingerprints are replicated.  Crowded anchors are cut into blocks of homes
and visitors that meet pairwise in different tasks.  A task returns a spanning forest of the
links it finds, never all pairs; components come from rounds of star contractions on written
tables.

One fingerprint of three bits reaches near copies only where very little differs, so `keep_one`
looks for them on smaller blocks: each half of each of PRINTS fingerprints is a block with
anchors of its own, where all that are within two bits of an anchor meet, and what differs in
few bits of the whole and of the next two fingerprints is a candidate.  Its fingerprints are of a
text's different words, of which an edit changes fewer than of shingles.  Candidates make
groups, and within a group all texts' sets of shingles are compared themselves: fingerprints
only decide what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Of `keep_one`: fingerprints a text, bits of 192 in which candidates differ at most, words of a shingle and least similarity.
PRINTS, FAR, WIDE_SHINGLE, SIMILAR = 5, 42, 5, 0.8
#: Row numbers that are sent to every executor (about 30 bytes each).
BROADCAST_NUMBERS = 4_000_000
#: Texts of a group of candidates that one task compares; larger groups are cut into parts that meet pairwise.
GROUP = 2_000
#: Rows of an anchor from which it is cut into blocks of as many rows.
CROWD = 8_000
#: Pairs that one task compares at a time.
PAIRS = 2_000_000
#: Masks of the parity checks of the 31-bit Hamming code: check k covers positions with bit k set.
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def _mixed(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Other hashes of what has these, one for each kind (the finaliser of SplitMix64); kind 0: as they are."""
    if not kind:
        return hashes
    # fixed values: the generator's increment and multipliers
    z = hashes + np.uint64(0x9E3779B97F4A7C15 * kind % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, prints: int = 1) -> np.ndarray:
    """`prints` 64-bit numbers a text, a row each: bit set where over half the shingles' hashes have it; no word: 0.

    The first is of XXH64, the others of the same hashes mixed.
    """
    out = np.zeros((len(texts), prints), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes = np.array([digest(joined, SEED)], np.uint64)
        else:
            starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist(), strict=True)], np.uint64)
        for kind in range(prints):
            ones = np.zeros(64, np.int64)
            for part in range(0, len(hashes), 65_536):
                ones += np.unpackbits(_mixed(hashes[part : part + 65_536], kind).byteswap().view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
            out[i, kind] = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
    return out


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fingerprints(batch.tolist())[:, 0].view(np.int64))

    return of(F.col(f"`{text}`"))


def word_fingerprints(text: str | None, prints: int) -> tuple[np.ndarray, str]:
    """`prints` 64-bit numbers of the different words of a text, and a digest of all its words in order."""
    words = (text or "").encode().lower().split()
    out = np.zeros(prints, np.uint64)
    if words:
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in set(words)], np.uint64)
        for kind in range(prints):
            ones = np.zeros(64, np.int64)
            for part in range(0, len(hashes), 65_536):
                ones += np.unpackbits(_mixed(hashes[part : part + 65_536], kind + 1).byteswap().view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
            out[kind] = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
    return out, xxhash.xxh3_128_hexdigest(b" ".join(words))


def _prints(text: str, prints: int) -> Column:
    @F.pandas_udf("fps array<long>, words string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [word_fingerprints(t, prints) for t in batch]
            yield pd.DataFrame({"fps": [p.view(np.int64) for p, _ in made], "words": [d for _, d in made]})

    return of(F.col(f"`{text}`"))


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Different 32-bit hashes of a text's shingles; of fewer words the whole sequence, of none nothing."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int32)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh32_intdigest(joined, SEED)], np.uint32).view(np.int32)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    return np.unique(np.array([xxhash.xxh32_intdigest(joined[a:b], SEED) for a, b in zip(starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist(), strict=True)], np.uint32).view(np.int32))


def _shingles(text: str) -> Column:
    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t) for t in batch], dtype=object)

    return of(F.col(f"`{text}`"))


def _flips(syndrome: int) -> list[int]:
    """What leads from 31 bits with this syndrome to each codeword within two bits; the nearest first."""
    bit = lambda i: 1 << (i - 1)
    return [bit(syndrome)] + [bit(i) | bit(i ^ syndrome) for i in range(1, 32) if i < i ^ syndrome and i != syndrome] if syndrome else [0]


def _along(distinct: DataFrame) -> list[str]:
    return [c for c in ("node", "also", "more") if c in distinct.columns]


def at_anchors(distinct: DataFrame) -> DataFrame:
    """(anchor, fp, home) rows, 31 a fingerprint on average; `distinct` has a long column fp.

    Columns `node`, `also` and `more` go along; those of different `kind` (a small number) have different anchors.
    """
    node = _along(distinct)
    kind = F.shiftleft(F.col("kind").cast("long"), 32) if "kind" in distinct.columns else F.lit(0).cast("long")
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in _flips(s)]) for s in range(32)])
    sides = []
    for half in (0, 1):
        bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit((1 << 31) - 1))
        syndrome = sum((F.bit_count(F.col("bits").bitwiseAND(F.lit(mask))) % 2 * (1 << k) for k, mask in enumerate(CHECKS)), F.lit(0))
        side = distinct.select("fp", *node, kind.alias("kind"), bits.alias("bits")).select("fp", *node, "kind", "bits", F.posexplode(F.element_at(flips, (syndrome + 1).cast("int"))).alias("pos", "flip"))
        sides.append(side.select((F.col("bits").bitwiseXOR(F.col("flip")) + F.lit(half << 31) + F.col("kind")).alias("anchor"), "fp", (F.col("pos") == 0).alias("home"), *node))
    return sides[0].unionByName(sides[1])


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b, and for each the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (label[x], label[y], x, y):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by block in; (node, root) of the links within blocks out, at most one row a node and window.

    A row's node is its column `node` if there is one, else its fingerprint; bits of columns
    `also` and `more` count with the fingerprint's.
    """

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        block, fp, home = (rows[c].to_numpy() for c in ("block", "fp", "home"))
        of = rows["node"].to_numpy() if "node" in rows else fp
        besides = [rows[c].to_numpy() for c in ("also", "more") if c in rows]
        first = np.searchsorted(block, block)
        size = np.searchsorted(block, block, "right") - first
        at = np.flatnonzero(home & (size > 1))
        node, root = np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.cumsum(size[at])
        done = 0
        while done < len(at):
            until = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + PAIRS, "right")))
            part = at[done:until]
            left = np.repeat(part, size[part])
            right = first[left] + np.arange(len(left)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            # counted on unsigned numbers: of signed ones numpy counts the absolute value
            apart = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64))
            for bits_of in besides:
                apart += np.bitwise_count((bits_of[left] ^ bits_of[right]).view(np.uint64))
            near = apart <= bits
            node, root = _roots(np.concatenate((node, of[left[near]])), np.concatenate((root, of[right[near]])))
            done = until
        apart = node != root
        return pd.DataFrame({"node": node[apart], "root": root[apart]})

    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat((rest, batch), ignore_index=True)
        cut = int((batch["block"] != batch["block"].iloc[-1]).sum()) if len(batch) else 0
        rest = batch.iloc[cut:]
        if cut:
            yield links(batch.iloc[:cut])
    if rest is not None and len(rest):
        yield links(rest)


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(node, root) edges whose components are those of all pairs of fingerprints at most `bits` apart (0 to 3).

    `distinct` as in `at_anchors`, each fingerprint of a kind once; nodes are its column `node`
    if there is one, else fingerprints.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the two halves cover up to 3 differing bits")
    return _met(distinct, at_anchors(distinct), bits)


def candidates(distinct: DataFrame, bits: int) -> DataFrame:
    """(node, root) edges whose components are those of all pairs that meet at an anchor and differ in at most `bits` bits.

    Whatever is within two bits of an anchor meets there, so all pairs meet of which a half
    differs in two bits, and some that differ in more.
    """
    return _met(distinct, at_anchors(distinct).withColumn("home", F.lit(True)), bits)


def _met(distinct: DataFrame, rows: DataFrame, bits: int) -> DataFrame:
    node = _along(distinct)
    crowded = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter((F.col("n") > CROWD) & (F.col("homes") > 0))
    crowded = written(crowded.select(F.col("anchor").alias("crowd"), F.ceil(F.col("n") / CROWD).cast("long").alias("v"), F.ceil(F.col("homes") / CROWD).cast("long").alias("h")), "crowds")
    blocks = rows.withColumn("block", F.lit(0).cast("long"))
    if not crowded.isEmpty():
        # every home block meets every visitor block once: a row at home goes to a block of both kinds
        many = rows.join(crowded, rows["anchor"] == crowded["crowd"], "left")
        own = lambda n: F.pmod(F.xxhash64("fp"), F.coalesce(n, F.lit(1)))
        visits = many.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("h", F.lit(1)) - 1), lambda i: i * F.coalesce("v", F.lit(1)) + own(F.col("v"))))).withColumn("home", F.col("home") & F.col("crowd").isNull())
        homes = many.filter("home and crowd is not null").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("v") - 1), lambda i: own(F.col("h")) * F.col("v") + i)))
        blocks = visits.select("anchor", "fp", "home", "block", *node).unionByName(homes.select("anchor", "fp", "home", "block", *node))
    dealt = blocks.select(F.xxhash64("anchor", "block").alias("block"), "fp", "home", *node).repartition("block").sortWithinPartitions("block")
    return dealt.mapInPandas(lambda batches: _forest(batches, bits), "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root), one row for each node that isn't the smallest of its component.

    Alternating star contractions: every larger end moves to its smaller end's smallest
    neighbour, then a node's smaller neighbours are hung below the smallest of them.  Ends when
    every node has one smaller neighbour, which has none.
    """
    edges = written(edges.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).filter("node != root").distinct(), "edges")
    while True:
        low = edges.groupBy(F.col("node").alias("at")).agg(F.min("root").alias("low"), F.count("*").alias("n"))
        jumped = edges.join(low.select("at", "low"), F.col("root") == F.col("at"), "left").select("node", F.coalesce("low", "root").alias("root")).distinct()
        low = jumped.groupBy(F.col("node").alias("at")).agg(F.min("root").alias("low"))
        hung = jumped.join(low, F.col("node") == F.col("at")).select(F.explode(F.array(F.struct("node", F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))).alias("e")).select("e.node", "e.root").filter("node != root").distinct()
        edges = written(hung, "edges")
        many = edges.groupBy("node").count().filter("count > 1").limit(1)
        chain = edges.join(edges.select(F.col("node").alias("at")), F.col("root") == F.col("at"), "left_semi").limit(1)
        if many.isEmpty() and chain.isEmpty():
            return edges


def _rooted(distinct: DataFrame, bits: int) -> DataFrame:
    """`distinct`, one row a fingerprint fp, with the smallest fingerprint of its component as root."""
    roots = components(links(distinct.select("fp"), bits))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def with_components(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) for each row of `docs`.

    Null and empty texts have fingerprint zero and link like any other.  A null id never is a
    component's number unless all ids of the component are null.  Repeated rows come out
    repeated.
    """
    rows = written(docs.select(F.col(f"`{id}`").alias("id"), fingerprint(text).alias("fp")), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    rooted = _rooted(distinct, bits)
    lowest = rooted.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("component_id"))
    numbered = written(rooted.join(lowest, F.col("root") == F.col("of")).select(F.col("fp").alias("of"), "component_id"), "components")
    return rows.join(numbered, F.col("fp") == F.col("of")).select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def alike(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs whose sets have at least this share in common (Jaccard); empty sets have no partner.

    Sets whose numbers most others have come first, and what is linked already isn't
    compared again: of a group around one text that text finds nearly all.
    """
    size = np.array([len(x) for x in sets])
    values, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by_term = np.argsort(term, kind="stable")
    held, many = owner[by_term], np.bincount(term, minlength=len(values))
    start = many.cumsum() - many
    own = np.concatenate(([0], size.cumsum()))
    central = np.bincount(owner, many[term], len(sets)) / np.maximum(size, 1)
    label, edges = np.arange(len(sets)), []
    for i in np.argsort(-central, kind="stable").tolist():
        apart = label != label[i]
        if not size[i] or not apart.any():
            continue
        of = term[own[i] : own[i + 1]]
        n = many[of]
        places = np.repeat(start[of] - (n.cumsum() - n), n) + np.arange(n.sum())
        common = np.bincount(held[places], minlength=len(sets))
        hits = np.flatnonzero(apart & (common > 0) & (common >= least * (size[i] + size - common)))
        if len(hits):
            trees, one = np.unique(label[hits], return_index=True)
            edges += [(i, int(h)) for h in hits[one]]
            label[np.isin(label, trees)] = label[i]
    return edges


def alike_in_groups(members: DataFrame, least: float = SIMILAR, most: int = GROUP) -> DataFrame:
    """(node, root) pairs whose components are those of all pairs of a group with similar sets; `members` as (of, group, set), each `of` once."""
    parts = written(members.groupBy("group").agg(F.ceil(F.count("*") / most).cast("long").alias("parts")).filter("parts > 1").toDF("large", "parts"), "large-groups")
    whole = members.withColumn("block", F.xxhash64("group", F.lit(0).cast("long"), F.lit(0).cast("long")))
    if not parts.isEmpty():
        # every two parts of a large group meet in one block
        met = members.join(parts, F.col("group") == F.col("large"), "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        part = F.pmod(F.xxhash64("of"), F.col("parts"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        spread = met.withColumn("part", part).withColumn("other", other)
        whole = spread.withColumn("block", F.xxhash64("group", F.least("part", "other"), F.greatest("part", "other")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(rows: pd.DataFrame) -> list[tuple[int, int]]:
            of = rows["of"].to_numpy()
            return [(max(of[x], of[y]), min(of[x], of[y])) for x, y in alike(list(rows["set"]), least)]

        rest = None
        for batch in batches:
            batch = pd.concat((rest, batch), ignore_index=True) if rest is not None else batch
            edges, rest = [], None
            if len(batch):
                last = batch["block"].iloc[-1]
                for key, rows in batch.groupby("block", sort=False):
                    if key == last:
                        rest = rows
                    elif len(rows) > 1:
                        edges += block(rows)
            yield pd.DataFrame(edges, columns=["node", "root"], dtype="int64")
        if rest is not None and len(rest) > 1:
            yield pd.DataFrame(block(rest), columns=["node", "root"], dtype="int64")

    return whole.select("block", "of", "set").repartition("block").sortWithinPartitions("block").mapInPandas(compare, "node long, root long")


def _few(numbers: DataFrame) -> DataFrame:
    """Counted rows of numbers are broadcast up to BROADCAST_NUMBERS; beyond that the texts are shuffled to meet them."""
    return F.broadcast(numbers) if numbers.count() <= BROADCAST_NUMBERS else numbers


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = SIMILAR, prints: int = PRINTS) -> DataFrame:
    """One row of `docs` for each group of near copies, columns as they were: the smallest id, nulls last, then the first row.

    Groups are connected by pairs whose sets of five-word shingles are `least` alike or more
    (A-Z lower-cased; texts of fewer words by their whole sequence); rows of equal words are
    always one group, so are all without a word.  Which texts are compared, fingerprints say:
    all of a group of `candidates` (two texts that differ in at most FAR bits of three
    fingerprints, in two or fewer of half of one, and what these connect).  Of pairs of
    similarity 0.8 nine in ten are found so (tested on planted copies), of more alike ones
    almost all.

    Rows are told apart by a written number, not by their id, so components may share an id or
    have none.
    """
    number = free_name(docs, "row_number")
    # written: the number has to be the same wherever it is read
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(number).alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = texts.select("row", "id", _prints("text", prints).alias("p")).select("row", "id", "p.fps", "p.words")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    # rows of equal words are one class, a node by the number of its first row
    each = written(rows.select("row", "words", "fps", first.alias("low")), "fingerprints")
    classes = written(each.groupBy("words").agg(F.min("low").alias("low"), F.first("fps").alias("fps")), "classes")
    # each fingerprint with the next two of its text
    prints_of = classes.select(F.col("low")["row"].alias("class"), "fps", F.posexplode("fps").alias("kind", "fp")).select("class", "kind", "fp", *[F.get("fps", (F.col("kind") + i) % prints).alias(c) for i, c in ((1, "also"), (2, "more"))])
    # classes of the same three fingerprints meet the first of them only
    heads = written(prints_of.groupBy("kind", "fp", "also", "more").agg(F.min("class").alias("node"), F.count("*").alias("n")), "heads")
    shared = heads.filter("n > 1").select("kind", "fp", "also", "more", F.col("node").alias("root"))
    same = prints_of.join(shared, ["kind", "fp", "also", "more"]).filter("class != root").select(F.col("class").alias("node"), "root")
    met = components(candidates(heads.select("kind", "fp", "also", "more", "node"), FAR).unionByName(same))
    groups = met.select(F.col("node").alias("of"), F.col("root").alias("group")).unionByName(met.select(F.col("root").alias("of"), F.col("root").alias("group")).distinct())
    groups = written(groups, "groups")
    # only texts of candidates are read again
    members = written(texts.join(_few(groups), F.col("row") == F.col("of")).select("of", "group", _shingles("text").alias("set")), "members")
    roots = components(alike_in_groups(members, least))
    rooted = classes.select("words", "low", F.col("low")["row"].alias("class")).join(roots, F.col("class") == F.col("node"), "left").select("words", "low", F.coalesce("root", "class").alias("tree"))
    # of a group the class with the smallest first row stays, and in it that row
    keep = rooted.groupBy(F.col("tree").alias("of")).agg(F.min("low").alias("best")).select("of", F.col("best")["row"].alias("best"))
    stays = rooted.join(keep, F.col("tree") == F.col("of")).select(F.col("words").alias("same"), "best")
    gone = written(each.select("row", "words").join(stays, F.col("words") == F.col("same")).filter("row != best").select(F.col("row").alias(number)), "gone")
    # what goes is less than what stays
    return numbered.join(_few(gone), number, "left_anti").drop(number)
