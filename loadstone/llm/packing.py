"""Filling fixed-capacity containers with whole items by bin completion."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadstone.llm import bpe

CAPACITY = 2048
#: Items that are packed together, in one task; more items make more groups. The loss is below one container a group.
GROUP_ITEMS = 12_500
#: Fillings looked at for one container before the search goes on with those so far.
FILLINGS = 400
#: Fillings looked at for one group before the best packing so far is taken.
BUDGET = 1_000_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items of each container. `sizes` is sorted, largest first.

    The open containers are kept by free space; a bit set tells the smallest sufficient space at once.
    """
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0
    for k, size in enumerate(sizes):
        fit = open_spaces >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
            bins[b].append(k)
        else:
            space, b = capacity, len(bins)
            bins.append([k])
        left = space - size
        by_space[left].append(b)
        open_spaces |= 1 << left
    return bins


@dataclass
class Search:
    """What bin_completion found: containers, the lower bound, best fit's number, fillings looked at; proven: none is fewer."""

    bins: list[list[int]]
    bound: int
    best_fit: int
    looked_at: int
    proven: bool


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers needed at least (Martello and Toth's L2): items over half a container, and what doesn't fit beside them."""
    best = -(-sum(sizes) // capacity)
    ordered = np.sort(np.asarray(sizes, np.int64))
    sums = np.concatenate([[0], np.cumsum(ordered)])
    at = lambda x: int(np.searchsorted(ordered, x, "right"))  # noqa: E731  items of size x or less
    half = at(capacity // 2)
    for k in sorted({0, *ordered[:half].tolist()}):
        # k to half a container: small; over half, up to capacity - k: large with room; over that: alone
        low, room = at(k - 1), at(capacity - k)
        large, alone = room - half, len(ordered) - room
        small = int(sums[half] - sums[low])
        free = large * capacity - int(sums[room] - sums[half])
        best = max(best, large + alone + max(0, -(-(small - free) // capacity)))
    return best


def dominated(filling: list[int], waste: int, left: int) -> bool:
    """Whether a left-over size (bit set `left`) can take the place of items of the filling, or of none, that fit into it.

    The items taken out fit where the left-over item was, so another packing is as good: only the filling with the item
    need be looked at. One item for an equal one is no change and doesn't count.
    """
    one, more = 1, 0  # sums of at most one item, of more
    single = 0
    for s in filling:
        more |= (more | single) << s
        single |= 1 << s
    one |= single
    if more & left:
        return True
    reach, span = (one | more) << 1, 1
    if not waste:
        return False
    while span < waste:
        step = min(span, waste - span)
        reach |= reach << step
        span += step
    return bool(reach & left)


def fillings(space: int, sizes: list[int], counts: list[int], from_index: int, most_waste: int, limit: int) -> tuple[list[tuple[int, list[int]]], int, bool]:
    """The fillings (waste, sizes by index) of `space` that aren't dominated and waste at most `most_waste`, least waste
    first; the nodes looked at; and whether all were (`limit` wasn't reached).
    """
    n = len(sizes)
    left = 0
    for i in range(from_index, n):
        if counts[i]:
            left |= 1 << sizes[i]
    smallest = (left & -left).bit_length() - 1 if left else space + 1
    amount = sum(sizes[i] * counts[i] for i in range(from_index, n))
    out: list[tuple[int, list[int]]] = []
    nodes, whole = 0, True
    path: list[int] = []
    stack = [(from_index, space, amount)]  # next size, space and what can still come
    while stack:
        i, room, rest = stack.pop()
        while i < n and (sizes[i] > room or not counts[i]):
            rest -= sizes[i] * counts[i]
            i += 1
        if i < n and room >= smallest and room - rest <= most_waste:
            if nodes >= limit:
                whole = False
                break
            nodes += 1
            # without this size later; with one of it now
            stack.append((i + 1, room, rest - sizes[i] * counts[i]))
            stack.append((-1, i, 0))
            counts[i] -= 1
            path.append(i)
            stack.append((i, room - sizes[i], rest - sizes[i]))
            continue
        if i >= n or room < smallest:
            if room <= most_waste:
                unused = left
                for k in set(path):
                    if not counts[k]:
                        unused &= ~(1 << sizes[k])
                if not dominated([sizes[k] for k in path], room, unused):
                    out.append((room, path.copy()))
        while stack and stack[-1][0] == -1:
            counts[stack.pop()[1]] += 1
            path.pop()
    while path:
        counts[path.pop()] += 1
    out.sort(key=lambda f: f[0])
    return out, nodes, whole


def bin_completion(sizes: list[int], capacity: int = CAPACITY, limit: int = FILLINGS, budget: int = BUDGET) -> list[list[int]]:
    """Indexes of the items of each container, as few containers as found: see search()."""
    return search(sizes, capacity, limit, budget).bins


def search(sizes: list[int], capacity: int = CAPACITY, limit: int = FILLINGS, budget: int = BUDGET) -> Search:
    """Branch and bound over containers. `sizes`: 1 to capacity, largest first.

    The incumbent is best-fit decreasing; at the lower bound it is taken. Else containers are completed around the largest
    remaining item by each filling that isn't dominated, the least wasteful first, as often as the items allow or less
    often; first a part of all counts is packed and repeated. A branch is cut when its waste rules out an improvement on the incumbent. Branches are taken by their number of
    departures from the first choice (none, one, two, ...), so early containers are revisited as soon as late ones. The
    search ends at the lower bound, when all branches were seen, or after `budget` fillings looked at (`limit` for one
    container); only the last leaves the result unproven.
    """
    incumbent = best_fit(sizes, capacity)
    total, bound = sum(sizes), lower_bound(sizes, capacity)
    found = Search(incumbent, bound, len(incumbent), 0, len(incumbent) <= bound)
    if found.proven:
        return found
    distinct = sorted(set(sizes), reverse=True)
    place = {s: i for i, s in enumerate(distinct)}
    counts = [0] * len(distinct)
    for s in sizes:
        counts[place[s]] += 1
    best: list[tuple[list[int], int]] | None = None
    fewest, all_seen = len(incumbent), True
    # sizes that come again and again: a packing of a part of all counts, repeated, and the rest by best fit
    for q in sorted({gcd(*counts), min(counts), int(np.median(counts))} - {1}, reverse=True):
        part = search([s for s, c in zip(distinct, counts) for _ in range(c // q)], capacity, limit, budget // 8)
        rest = [s for s, c in zip(distinct, counts) for _ in range(c % q)]
        rest_bins = best_fit(rest, capacity)
        found.looked_at += part.looked_at
        if len(part.bins) * q + len(rest_bins) < fewest:
            fewest = len(part.bins) * q + len(rest_bins)
            of_part = [s for s, c in zip(distinct, counts) for _ in range(c // q)]
            best = [([place[of_part[k]] for k in b], q) for b in part.bins] + [([place[rest[k]] for k in b], 1) for b in rest_bins]

    def branches(at: int, waste: int):
        """(filling, times), all fillings as often as possible first."""
        nonlocal all_seen
        counts[at] -= 1
        most = (fewest - 1) * capacity - total - waste
        options, nodes, whole = fillings(capacity - distinct[at], distinct, counts, at, most, min(limit, max(1, budget - found.looked_at)))
        counts[at] += 1
        found.looked_at += nodes + 1
        all_seen &= whole
        runs = []
        for loss, filling in options:
            uses = Counter([at, *filling])
            runs.append((loss, [at, *filling], min(counts[i] // k for i, k in uses.items())))
        for loss, filling, times in runs:
            yield loss, filling, times
        for loss, filling, times in runs:
            for fewer in range(times - 1, 0, -1):
                yield loss, filling, fewer

    departures = 0
    while fewest > bound and found.looked_at < budget:
        skipped = False
        # frames: branches, the one in use, containers and waste before, departures left, the first size that may remain
        stack: list[list] = []
        used, waste, spare, at = 0, 0, departures, 0
        descend = True
        while descend or stack:
            if descend:
                while at < len(distinct) and not counts[at]:
                    at += 1
                if at == len(distinct):
                    if used < fewest:
                        fewest, best = used, [f[1] for f in stack]
                    if fewest <= bound:
                        break
                else:
                    stack.append([branches(at, waste), None, used, waste, spare, at, 0])
            descend = False
            if found.looked_at >= budget or not stack:
                break
            frame = stack[-1]
            if frame[1]:
                for i in frame[1][0]:
                    counts[i] += frame[1][1]
                frame[1] = None
            choice = next(frame[0], None)
            if choice is None or (frame[6] and not frame[4]):
                skipped |= choice is not None
                stack.pop()
                continue
            loss, filling, times = choice
            spare = frame[4] - (frame[6] > 0)
            frame[6] += 1
            found.looked_at += 1
            if frame[3] + loss * times > (fewest - 1) * capacity - total:
                continue
            for i in filling:
                counts[i] -= times
            frame[1] = (filling, times)
            used, waste, at, descend = frame[2] + times, frame[3] + loss * times, frame[5], True
        for frame in stack:
            if frame[1]:
                for i in frame[1][0]:
                    counts[i] += frame[1][1]
        if fewest <= bound or found.looked_at >= budget or not skipped:
            break
        departures += 1
    found.proven = fewest <= bound or (found.looked_at < budget and all_seen)
    if best is not None:
        members: list[list[int]] = [[] for _ in distinct]
        for k in range(len(sizes) - 1, -1, -1):
            members[place[sizes[k]]].append(k)
        found.bins = [[members[i].pop() for i in filling] for filling, times in best for _ in range(times)]
    return found


def pack(sized: DataFrame, items: int, item: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Put the items of `sized` (columns `item`, `size` and spread, a bigint hash) into containers of `capacity`.

    One row per piece: bin_id, the item, piece (from 0), start (the first unit of the piece in its item), n_tokens. An item
    that fits is one piece. A larger one is cut into full pieces, each a container of its own, and a rest that is packed as
    an item. An item of size 0, null or less takes no space and goes to the group's first container. `items` is the number
    of rows or a bound of it: items are spread over ceil(items / group_items) groups by their hash, every group a fair
    sample of all sizes, and each group is packed in one task of bounded size. Repeated rows are items of their own.
    """
    groups = max(1, -(-items // group_items))
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0))
    rows = sized.select(F.col(item).alias("item"), n.alias("n"), F.pmod(F.col("spread"), F.lit(groups)).cast("int").alias("g"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("n", "descending"), ("item", "ascending")])
        sizes = table["n"].to_numpy()
        whole, rest = sizes // capacity, sizes % capacity
        # full pieces first: their containers are 0, 1, ...
        owner = np.repeat(np.arange(len(sizes)), whole)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        parts = np.flatnonzero(rest)
        parts = parts[np.argsort(-rest[parts], kind="stable")]
        where = np.zeros(len(parts), np.int64)
        for b, ks in enumerate(bin_completion(rest[parts].tolist(), capacity)):
            where[ks] = b
        empty = np.flatnonzero(sizes == 0)
        rows = np.concatenate([owner, parts, empty])
        pieces = np.concatenate([piece, whole[parts], np.zeros_like(empty)])
        tokens = np.concatenate([np.full(len(owner), capacity), rest[parts], np.zeros_like(empty)])
        bins = np.concatenate([np.arange(len(owner)), where + len(owner), np.zeros_like(empty)])
        first = int(table["g"][0].as_py()) << 32
        return pa.table({"bin_id": first + bins, "item": table["item"].take(pa.array(rows)), "piece": pieces, "start": pieces * capacity, "n_tokens": tokens})

    kind = sized.schema[item].dataType.simpleString()
    packed = rows.groupBy("g").applyInArrow(run, f"bin_id bigint, item {kind}, piece bigint, start bigint, n_tokens bigint")
    return packed.withColumnRenamed("item", item)


def report(sized: DataFrame, items: int, size: str = "n_tokens", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """How pack() searched: per group the containers of what isn't cut to full pieces, the lower bound, best fit's number,
    the fillings looked at, and whether no packing has fewer (else the search budget ran out).
    """
    groups = max(1, -(-items // group_items))
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0)) % capacity
    rows = sized.select(n.alias("n"), F.pmod(F.col("spread"), F.lit(groups)).cast("int").alias("g"))

    def run(table: pa.Table) -> pa.Table:
        sizes = np.sort(table["n"].to_numpy())[::-1]
        r = search(sizes[sizes > 0].tolist(), capacity)
        return pa.table({"g": [table["g"][0].as_py()], "containers": [len(r.bins)], "bound": [r.bound], "best_fit": [r.best_fit], "looked_at": [r.looked_at], "proven": [r.proven]})

    return rows.groupBy("g").applyInArrow(run, "g bigint, containers bigint, bound bigint, best_fit bigint, looked_at bigint, proven boolean")


def _sized(documents: DataFrame, vocabulary: bpe.Vocabulary | None) -> DataFrame:
    slim = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("spread"))
    return bpe.count_tokens(slim, "text", "n_tokens", vocabulary)


def report_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: bpe.Vocabulary | None = None) -> DataFrame:
    return report(_sized(documents, vocabulary), documents.select().count(), capacity=capacity)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: bpe.Vocabulary | None = None) -> DataFrame:
    """Documents (doc_id, text) in containers of `capacity` tokens: bin_id, doc_id, piece, start, n_tokens.

    The sizes are counted where the texts are read; only (doc_id, size, hash) is shuffled. Null, empty and blank texts and
    an empty table: see pack().
    """
    return pack(_sized(documents, vocabulary), documents.select().count(), capacity=capacity)
