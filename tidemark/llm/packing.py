"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

LENGTH = 2048
#: the id that ends each document
END = 0
#: rows that are numbered together within one length
RUN_ROWS = 256
#: texts are encoded in stretches of about so many code points
STRETCH = 1 << 20


#: how a byte-level BPE tokenizer parts texts before it merges, as its kind has it
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Plain:
    """The tokenizers library's own encoder, for files that are not of the plain kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str, allowed_special=None) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _is_plain(spec: dict) -> bool:
    """Whether a file is a byte-level BPE without normalizer, its own way of parting texts, or merges out of the order of ids."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    return None not in merged and all(a < b for a, b in zip(merged, merged[1:], strict=False)) and all(not t.get("normalized", False) or t["special"] for t in spec.get("added_tokens", []))


def _encoder(path: str):
    """A byte-level BPE tokenizer's file as an encoder that gives the same ids, several times as fast; for any other file
    the library's own.

    In this kind of vocabulary ids of merged tokens rise with the rank of their merge, and
    each character stands for a byte by the kind's fixed rule.
    """
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    if not _is_plain(spec):
        return _Plain(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-level", pat_str=PARTS, mergeable_ranks=ranks, special_tokens=special)


def encode(encoder, text: str) -> np.ndarray:
    """The ids of ``text``. Long texts go in stretches cut before a space between a visible
    character and a letter, where tokens always part."""
    out, at = [], 0
    while len(text) - at > STRETCH and not isinstance(encoder, _Plain):
        found = re.compile(r"(?<=\S) (?=[^\W\d_])").search(text, at + STRETCH)
        if not found:
            break
        out.append(np.array(encoder.encode(text[at : found.start()], allowed_special="all"), dtype=np.uint32))
        at = found.start()
    out.append(np.array(encoder.encode(text[at:] if at else text, allowed_special="all"), dtype=np.uint32))
    return np.concatenate(out) if len(out) > 1 else out[0]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Tokenized documents, each ended by id 0, as pieces of at most ``length`` ids.

    Only longer documents are cut; all of their pieces are full but perhaps the first.
    Null texts are empty and give one piece of one id. Repeated rows give repeated
    pieces. ``ids`` are little-endian unsigned 32-bit numbers (null without ``with_ids``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.doc_id, batch.text, strict=True):
                ids = np.append(encode(encoder, text or ""), np.uint32(END)).astype("<u4")
                first = (len(ids) - 1) % length + 1
                cuts = [0, *range(first, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    out.append((doc_id, k, a, b - a, zlib.crc32(raw), raw if with_ids else None))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def _price(lens: np.ndarray, value: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each capacity, and the item taken there (-1: none, go one down)."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(lens, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        if k := upto[w]:
            got = best[w - lens[:k]] + value[:k]
            j = int(got.argmax())
            if got[j] > best[w]:
                best[w], taken[w] = got[j], j
    return best, taken


def _fractional(lens: np.ndarray, need: np.ndarray, room: int, step: float, rate: float, slack: float, noise: float = 0.02) -> tuple[dict[tuple, float], float]:
    """Patterns and how often each is used, covering ``need``, and a lower bound of their number: multiplicative weights.

    A length's weight is its share of a sequence times ``exp(-rate * covered share)``.
    Pricing gives, for every length, the best pattern that holds it; those within
    ``slack`` of the best are used until one of their lengths has gained ``step``. The weights, divided by the best
    pattern's, are prices that no pattern exceeds, so what all pieces cost is a bound (the linear program's dual).
    """
    used: dict[tuple, float] = {}
    bound = float((lens * need).sum() / room)
    rng = np.random.default_rng(0)
    left = need.astype(float)
    while (open_ := np.flatnonzero(left > 1e-9)).size:
        ls = lens[open_]
        share = 1 - left[open_] / need[open_]
        # a little noise, so that equal fillings of a gap take different lengths
        value = ls / room * np.exp(-rate * share) * (1 + noise * rng.random(len(ls)))
        best, taken = _price(ls, value, room)
        whole = value + best[room - ls]
        bound = max(bound, float((need[open_] * value).sum() / whole.max()))
        gained = np.zeros(len(ls))
        for j in np.argsort(-whole, kind="stable"):
            if whole[j] < (1 - slack) * whole.max():
                break
            if gained[j] >= step:
                continue
            items, w = [int(j)], int(room - ls[j])
            while w > 0:
                if (t := int(taken[w])) >= 0:
                    items.append(t)
                    w -= int(ls[t])
                else:
                    w -= 1
            at, count = np.unique(items, return_counts=True)
            if (gained[at] >= step).any():
                continue
            times = float(min((np.maximum(step * need[open_[at]], 1.0) / count).min(), (left[open_[at]] / count).min()))
            if times <= 0:
                continue
            key = tuple(zip(ls[at].tolist(), count.tolist(), strict=True))
            used[key] = used.get(key, 0.0) + times
            left[open_[at]] -= times * count
            gained[at] += times * count / need[open_[at]]
    return used, bound


def _best_fit(histogram: dict[int, int], room: int) -> dict[tuple, int]:
    """Longest first, each into the open sequence that it leaves with the least room. Sequences with the same content
    are counted, not listed, so the steps depend on the number of lengths alone."""
    by_room: list[dict[tuple, int]] = [{} for _ in range(room + 1)]
    open_ = np.zeros(room + 1, dtype=bool)
    for n, left in sorted(histogram.items(), reverse=True):
        while left:
            found = int(open_[n:].argmax()) + n
            if open_[found]:
                pattern, many = next(iter(by_room[found].items()))
            else:
                found, pattern, many = room, (), left
            # a sequence that has got one is the tightest for the next, until it is full
            each = min(found // n, left)
            times = min(many, left // each)
            if pattern:
                by_room[found].pop(pattern)
                if many > times:
                    by_room[found][pattern] = many - times
                open_[found] = bool(by_room[found])
            now = by_room[found - n * each]
            now[(*pattern, (n, each))] = now.get((*pattern, (n, each)), 0) + times
            open_[found - n * each] = True
            left -= times * each
    return {tuple(sorted(p)): c for patterns in by_room for p, c in patterns.items()}


def solve(histogram: dict[int, int], room: int = LENGTH, step: float = 0.5, rate: float = 0.5, slack: float = 0.3, rounds: int = 1) -> tuple[list[tuple[tuple, int]], float]:
    """``{length: count}`` to ``[(((length, times in the pattern), ...), sequences), ...]`` and a lower bound of
    the number of sequences (the greatest that the linear programs' duals gave).

    The linear program is solved by ``_fractional`` and rounded, the fullest patterns first: up, as far as there are pieces,
    where the pattern is full, else down. What is left over is solved again, at most ``rounds`` times, and
    a remainder that no longer rounds to patterns (its size depends on the number of
    lengths, not on the data) is placed by best fit, together with at most half of the patterns, opened up again, where
    that brings the number nearer to the bound. Every piece is placed.
    """
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    out: dict[tuple, int] = {}
    full = left.pop(room, 0)
    if full:
        out[((room, 1),)] = full
    bound = 0.0
    for k in range(rounds):
        if not left:
            break
        lens, need = np.array(list(left)), np.array(list(left.values()))
        found, low = _fractional(lens, need, room, step, rate, slack)
        bound, before = bound if k else low, sum(left.values())
        for pattern, x in sorted(found.items(), key=lambda p: (-sum(n * a for n, a in p[0]), -p[1], p[0])):
            is_full = sum(n * a for n, a in pattern) == room
            times = min(int(np.ceil(x - 1e-6)) if is_full else int(x + 1e-6), min(left.get(n, 0) // a for n, a in pattern))
            if times > 0:
                out[pattern] = out.get(pattern, 0) + times
                for n, a in pattern:
                    left[n] -= times * a
        left = {n: c for n, c in left.items() if c}
        if sum(left.values()) > 0.9 * before:
            break
    # last, patterns are opened up again, the least full and those of most pieces first, while that leaves fewer sequences
    order = sorted((p for p in out if p[0][0] != room), key=lambda p: (sum(n * a for n, a in p), -sum(a for _, a in p)))
    best, opened, most = None, 0, np.ceil(full + bound - 1e-6)
    while True:
        rest = _best_fit(left, room)
        total = sum(out.values()) + sum(rest.values())
        if best is None or total < best[0]:
            best = total, dict(out), rest
        if best[0] <= most or opened >= len(order) // 2:
            break
        more = order[opened : max(16, 2 * opened)]
        opened += len(more)
        for pattern in more:
            times = out.pop(pattern)
            for n, a in pattern:
                left[n] = left.get(n, 0) + a * times
    _, out, rest = best
    for pattern, times in rest.items():
        out[pattern] = out.get(pattern, 0) + times
    return list(out.items()), full + bound


def _slots(patterns: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, pieces in one sequence, first sequence, offset), by rank."""
    slots: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n, a in sorted(pattern, reverse=True):
            slots.setdefault(n, []).append((ranks.get(n, 0), a, sequence, offset))
            ranks[n] = ranks.get(n, 0) + a * times
            offset += a * n
        sequence += times
    return {n: np.array(x, dtype=np.int64) for n, x in slots.items()}


def place(items: DataFrame, room: int = LENGTH) -> DataFrame:
    """``items`` (with ``length``, at most ``room``) with ``sequence_id`` and ``offset``.

    The driver sees the histogram, at most ``room`` rows, and sends back the slots of each
    length; their number depends on ``room`` alone. Rows are written first, with a number each. Pieces of one length
    are numbered in runs of about RUN_ROWS, and runs in parts of RUN_ROWS, so that a length with a third of all
    pieces is spread out. Equal rows are interchangeable. An empty table gives an empty one. Other columns are kept,
    but for ``sequence_id`` and ``offset``, which are replaced.
    """
    run, part, first, rank, at = (fresh(items, n) for n in ("piece_run", "piece_part", "piece_first", "piece_rank", "piece_at"))
    items = cut(items.drop("sequence_id", "offset", "runs").withColumn(at, F.monotonically_increasing_id()), "pieces")
    hist = {int(n): c for n, c in items.groupBy("length").count().collect()}
    slots = _slots(solve(hist, room)[0])
    runs = items.sparkSession.createDataFrame([(n, 1 + c // RUN_ROWS) for n, c in hist.items()], "length long, runs long")
    rows = items.join(F.broadcast(runs), "length")  # at most ``room`` rows
    rows = rows.withColumn(run, F.pmod(F.xxhash64(at), "runs")).withColumn(part, F.floor(F.col(run) / RUN_ROWS)).drop("runs")
    # rows before a run: those of the parts before its part, and of the runs before it in its part
    sizes = cut(rows.groupBy("length", part, run).count(), "piece-runs")
    ahead = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("length", part).agg(F.sum("count").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead(part, "length")), F.lit(0))).drop("n")
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(ahead(run, "length", part)), F.lit(0))).drop("count").join(parts, ["length", part])
    sizes = sizes.select("length", run, (F.col("before") + F.col("ahead")).alias(first))
    within = Window.partitionBy("length", run).orderBy(at)
    ranked = rows.join(sizes, ["length", run]).withColumn(rank, F.col(first) + F.row_number().over(within) - 1).drop(run, part, first, at)
    names = [c for c in ranked.columns if c != rank]
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.select(names).dtypes) + ", sequence_id long, offset long"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seq, off = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            length, ranks = batch.length.to_numpy(), batch[rank].to_numpy()
            for n in np.unique(length):
                at, s = np.flatnonzero(length == n), slots[int(n)]
                start, each, base, offset = s[np.searchsorted(s[:, 0], ranks[at], "right") - 1].T
                seq[at] = base + (ranks[at] - start) // each
                off[at] = offset + (ranks[at] - start) % each * n
            yield batch[names].assign(sequence_id=seq, offset=off)

    return ranked.mapInPandas(assign, schema)


def pack(docs: DataFrame, tokenizer: str, room: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Documents as placed pieces: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    See ``pieces`` and ``place``. Extra columns are left aside.
    """
    return place(pieces(docs, tokenizer, room, with_ids), room)


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences' ids: ``sequence_id, ids, n_ids``, at most one sequence's length each."""
    got = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_ids"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return got.select("sequence_id", joined.alias("ids"), "n_ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed_documents(docs: DataFrame) -> DataFrame:
    """``pack`` by the public tokenizer, without the ids themselves. Null texts are empty and give one piece; null doc_ids
    and repeated rows are kept; an empty table gives an empty one; other columns, whatever their names, are left aside."""
    return pack(docs, default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
