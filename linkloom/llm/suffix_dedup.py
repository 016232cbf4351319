"""Exact removal of repeated byte strings, by sorting sampled suffixes and inducing the others.

A byte goes if a ``length``-byte string that covers it also starts earlier. As in induced sorting, only
sampled suffixes are sorted: those at local minima of a hash of ``GRAM`` bytes over every window of
``length`` bytes (the part that leftmost S-type positions play). Content alone picks the sample, so
equal strings hold their sample at equal places, and each string of ``length`` bytes holds at least one.

1. Sample. Each sampled suffix gives a tuple: its name (hash of its first bytes), its class (hash of all
   bytes of the strings that it stands for, so equal classes agree to the left and right over their
   whole reach), and its place. Tuples are sorted externally, by the disk-backed shuffle, by name, class
   and place. Within a class all but the first place repeat in full; a name with one class is settled.
2. Induce. Names with several classes agree in part (ends of a shared passage, edited copies). Only
   the first place of such a class is taken apart, into bands of BAND neighbouring strings. Their tuples
   are sorted the same way: the name is what all strings of the band hold, the class all its bytes.
   What is still open then is compared string by string.
3. Documents take the places found and drop what they cover.

Hashes are 128 bits in all (name and class, or a string's). Repeats within a batch are settled before
the shuffle, so a string that a third of all documents hold is a few tuples for each task.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import materialize, small_batches

GRAM = 32
BAND = 8
CHUNK = 1 << 20
_LOW = np.uint64((1 << 21) - 1)
_random = random.Random(20)
_TABLES = [np.array([_random.getrandbits(64) for _ in range(256)], dtype=np.uint64) for _ in range(2)]
_BASES = [_random.getrandbits(64) | 1 for _ in range(2)]
_WRAP = (1 << 64) - 1
_powers: list[np.ndarray] = []

REPEATED, OPEN = 1, 2


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(_BASES[0], exponent, 1 << 64))


def _running_powers() -> list[np.ndarray]:
    """Powers of the second base and of its inverse, modulo 2^64."""
    if not _powers:
        for base in (_BASES[1], pow(_BASES[1], -1, 1 << 64)):
            table = np.full(CHUNK + 1, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on (doubling: a hash of 2n bytes from two of n)."""
    values, step = _TABLES[0][data], 1
    while step < GRAM:
        values = values[:-step] * _power(step) + values[step:]
        step *= 2
    values ^= values >> np.uint64(32)
    values *= np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    return values


def sampled(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of a chunk: names, classes, first string (lo), last string (hi), place.

    ``valid`` tells which places start a string of ``length`` bytes within one document.
    """
    names = gram_hashes(data)
    keys = (names & ~_LOW) | np.arange(len(names), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    if reach < width:
        keys = np.minimum(keys[: -(width - reach)], keys[width - reach :])
    starts = np.flatnonzero(valid)
    places = (keys[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, place = starts[first], starts[last], places[first]
    powers, inverses = _running_powers()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[1][data] * powers[: len(data)], out=sums[1:])
    classes = (sums[hi + length] - sums[lo]) * inverses[lo]
    classes ^= ((place - lo) * 128 + (hi - lo)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return names[place], classes, lo, hi, place


def chunks(bodies: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents laid end to end in stretches of up to CHUNK bytes.

    Gives the bytes, which places start a string, and for each place the document's number and the
    offset to add for its place in the document. A longer document comes in stretches that overlap.
    """
    parts: list[tuple[int, int, bytes]] = []
    filled = 0

    def laid() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        valid = np.arange(len(data)) + length <= np.repeat(ends, sizes)
        numbers = np.repeat(np.array([p[0] for p in parts]), sizes)
        offsets = np.repeat(np.array([p[1] for p in parts]) - (ends - sizes), sizes)
        return data, valid, numbers, offsets

    for number, body in enumerate(bodies):
        at = 0
        while len(body) - at >= length:
            part = body[at : at + CHUNK]
            if filled + len(part) > CHUNK:
                yield laid()
                parts, filled = [], 0
            parts.append((number, at, part))
            filled += len(part)
            at += len(part) - length + 1
    if parts:
        yield laid()


def settled(frame: pd.DataFrame) -> pd.DataFrame:
    """Settle what repeats within the batch: its place becomes ~place, its name one of its own, to be dealt evenly."""
    frame = frame.sort_values(["doc", "twin", "place"], kind="stable")
    key = ["name", "class"]
    done = frame.duplicated(key, keep="first") & ~frame.duplicated([*key, "doc", "twin", "place"], keep=False)
    own = frame.loc[done, "place"] * 0x9E3779B1 + frame.loc[done, "doc"] + frame.loc[done, "twin"]
    frame.loc[done, "name"] = [b"%d" % x for x in own] if frame["name"].dtype == object else own
    frame.loc[done, "place"] = ~frame.loc[done, "place"]
    return frame


def sample_tuples(docs: DataFrame, length: int) -> DataFrame:
    """(name, class, doc, twin, place); place packs lo, place - lo and hi - lo."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = batch["body"].tolist()
            ids = batch["doc"].to_numpy(dtype=np.int64)
            twins = batch["twin"].to_numpy(dtype=np.int64)
            for data, valid, numbers, offsets in chunks(bodies, length):
                names, classes, lo, hi, place = sampled(data, valid, length)
                if not len(lo):
                    continue
                number = numbers[lo]
                packed = ((lo + offsets[lo]) << 14) | ((place - lo) << 7) | (hi - lo)
                columns = {"name": names.view(np.int64), "class": classes.view(np.int64), "doc": ids[number], "twin": twins[number], "place": packed}
                yield settled(pd.DataFrame(columns))

    return docs.mapInPandas(scan, "name long, class long, doc long, twin long, place long")


def resolved(tuples: DataFrame) -> DataFrame:
    """(doc, twin, places) of sorted tuples: ~place of what repeats, place of what is open, none of the rest."""
    ranked = tuples.withColumn("rank", F.rank().over(Window.partitionBy("name", "class").orderBy("doc", "twin", "place")))
    several = Window.partitionBy("name")
    ranked = ranked.withColumn("several", F.min("class").over(several) != F.max("class").over(several))
    repeats = (F.col("place") < 0) | (F.col("rank") > 1)
    place = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place"))
    kept = ranked.where(repeats | F.col("several")).select("doc", "twin", F.when(repeats, F.bitwise_not(place)).otherwise(place).alias("place"))
    return kept.groupBy("doc", "twin").agg(F.collect_list("place").alias("places"))


def unpacked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = (places >> 14) & 0xFFFFFFFF
    return lo, lo + (places & 0x7F)


Spelling = Callable[[bytes, np.ndarray], Iterator[tuple[bytes, int, int]]]


def spelled(joined: DataFrame, strings: Spelling) -> DataFrame:
    """Tuples of what ``strings`` gives (name, class, place) for each document's open places."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, classes, ids, twins, places = [], [], [], [], []

        def frame() -> pd.DataFrame:
            columns = {"class": classes, "doc": ids, "twin": twins, "place": places}
            made = pd.DataFrame({"name": pd.Series(names, dtype=object)} | {k: np.array(v, dtype=np.int64) for k, v in columns.items()})
            for column in (names, classes, ids, twins, places):
                column.clear()
            return settled(made)

        for batch in batches:
            for doc, twin, body, marks in zip(batch["doc"], batch["twin"], batch["body"], batch["places"], strict=True):
                marks = np.asarray(marks, dtype=np.int64)
                for name, kind, place in strings(body, marks[marks >= 0]):
                    names.append(name)
                    classes.append(kind)
                    ids.append(doc)
                    twins.append(twin)
                    places.append(place)
                if len(names) >= 200_000:
                    yield frame()
        yield frame()

    some = joined.where(F.exists("places", lambda p: p >= 0)).select("doc", "twin", "body", "places")
    return some.mapInPandas(spell, "name binary, class long, doc long, twin long, place long")


def bands(length: int) -> Spelling:
    """The strings of a place in bands by their distance before it."""

    def strings(body: bytes, marks: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        lo, hi = unpacked(marks)
        for first, last, at in zip(lo.tolist(), hi.tolist(), (lo + ((marks >> 7) & 0x7F)).tolist(), strict=True):
            for band in range((at - last) // BAND, (at - first) // BAND + 1):
                start = at - BAND * band  # where the band's last string starts
                low, high = max(first, start - BAND + 1), min(last, start)
                name = xxhash.xxh3_128_digest(body[start : start + length - BAND + 1], seed=band)
                kind = xxhash.xxh3_64_intdigest(body[low : high + length], seed=(start - low) * BAND + high - low)
                yield name, kind - (1 << 63), (low << 14) | (high - low)

    return strings


def singles(length: int) -> Spelling:
    """Each string of a place, in a class of its own."""

    def strings(body: bytes, marks: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        for lo, hi in zip(*(x.tolist() for x in unpacked(marks)), strict=True):
            for at in range(lo, hi + 1):
                yield xxhash.xxh3_128_digest(body[at : at + length]), 0, at << 14

    return strings


def covered(size: int, marks: np.ndarray, length: int) -> np.ndarray:
    """Mask of the bytes that the repeated places cover."""
    lo, hi = unpacked(~marks[marks < 0])
    edges = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edges, lo, 1)
    np.add.at(edges, hi + length, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 100) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_bytes, a row per row of ``docs``.

    Null text is empty; texts shorter than ``length`` lose nothing. Earlier is a smaller id (null after all
    others) or, within a document, an earlier place. Equal rows of one id are one document that loses
    the same bytes in each; different texts of one id follow each other in the order of a 64-bit
    hash. An empty table gives an empty table.
    """
    if not GRAM <= length < GRAM + 127:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 126}")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = small_batches(docs).select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("doc"), body.alias("body"))
    # only texts that share an id are told apart by their hash; all others have twin 0, which takes no room in the shuffles
    hashed = F.xxhash64("body")
    shared = rows.groupBy(F.col("doc").alias("_doc")).agg(F.min(hashed).alias("_least"), F.max(hashed).alias("_most")).where("_least <> _most")
    # as a stored table its size is known, so Spark broadcasts it only if it is small
    shared = materialize(shared.select("_doc"), "shared-ids")
    twin = F.when(F.col("_doc").isNull(), F.lit(0)).otherwise(hashed).cast("long")
    # one shuffle of the texts serves all joins below
    twinned = rows.join(shared, F.col("doc") == F.col("_doc"), "left").select("doc", "body", twin.alias("twin"))
    identity = ["doc", "twin"]
    whole = resolved(sample_tuples(twinned, length))
    banded = resolved(spelled(twinned.join(whole, identity), bands(length)))
    single = resolved(spelled(twinned.join(banded, identity), singles(length)))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_bytes binary")
    def cut(bodies: pd.Series, *found: pd.Series) -> pd.DataFrame:
        out = []
        for body, *places in zip(bodies, *found, strict=True):
            places = [np.asarray(x, dtype=np.int64) for x in places if x is not None]
            if not places:
                out.append((len(body), 0, 0, body))
                continue
            gone = covered(len(body), np.concatenate(places), length)
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((len(body), int(gone.sum()), spans, np.frombuffer(body, dtype=np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_bytes"])

    joined = twinned
    for level, found in enumerate((whole, banded, single)):
        joined = joined.join(found.withColumnRenamed("places", f"places{level}"), identity, "left")
    made = joined.select("doc", cut("body", "places0", "places1", "places2").alias("_made"))
    last = F.lit(2**63 - 1)
    return made.select(F.when(F.col("doc") < last, F.col("doc")).alias(key), "_made.*")


def brute_force(documents: list[tuple[int, bytes]], length: int) -> dict[int, tuple[int, int, int, str]]:
    """The definition itself, for tests: id to (n_bytes, n_removed, n_spans, kept_sha256)."""
    first: set[bytes] = set()
    out = {}
    for doc, body in sorted(documents):
        gone = np.zeros(len(body), dtype=bool)
        for at in range(len(body) - length + 1):
            string = body[at : at + length]
            if string in first:
                gone[at : at + length] = True
            first.add(string)
        kept = np.frombuffer(body, dtype=np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc] = (len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out
