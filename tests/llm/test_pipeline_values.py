"""Each stage of the pipeline against plain Python on the stage's own input."""

import re
from collections import Counter, defaultdict

import pytest
import xxhash

from linkloom.llm import language_id, packing
from linkloom.llm.queries import LLM_SQL

F = pytest.importorskip("pyspark.sql.functions")
pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, by its name; stages hand over Parquet."""
    table, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before = table.collect()
        folder = str(tmp_path_factory.mktemp(name) / "documents.parquet")
        stage(spark, table, FOLDER).write.parquet(folder)
        table = spark.read.parquet(folder)
        found[name] = before, table.collect(), folder
    return found


def values(rows):
    return Counter(tuple(r) for r in rows)


def test_languages(spark, stages):
    before, after, _ = stages["language_id"]
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = language_id.fit(spark.read.parquet(f"{FOLDER}/documents.parquet").where(~held_out), "text", "lang", F.col("doc_id"))
    want = []
    for row in before:
        if re.search(r"[^\W\d_]", row["text"] or ""):
            (found,), (score,) = model.predict(language_id.text_features(row["text"].encode())[None, :])
            lang = found if score >= pipeline.SURE or row["lang"] is None else row["lang"]
            want.append(tuple({**row.asDict(), "lang": lang}.values()))
    assert values(after) == Counter(want)


def test_lines(stages):
    before, after, _ = stages["line_dedup"]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for row in before:
        for line in row["text"].split("\n"):
            holders[key(line)].add(row["doc_id"])
    last = {k: max(ids) for k, ids in holders.items() if len(k) >= 20 and len(ids) >= 3}
    want = []
    for row in before:
        lines = row["text"].split("\n")
        kept = [line for line in lines if last.get(key(line), row["doc_id"]) == row["doc_id"]]
        text = "\n".join(kept)
        if len(kept) == len(lines) or WORD.search(text):
            want.append(tuple({**row.asDict(), "text": text, "n_chars": len(text)}.values()))
    assert last and values(after) == Counter(want)


def plain_fingerprint(text):
    words = WORD.findall(text.translate(LOWER))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for gram in grams:
        bits = xxhash.xxh64_intdigest(gram.encode(), 42)
        for b in range(64):
            ones[b] += bits >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_near_duplicates(stages):
    before, after, _ = stages["simhash_dedup"]
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in before}
    near = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4] for i in prints}
    group, moved = {i: i for i in prints}, True
    while moved:
        least = {i: min(group[j] for j in near[i]) for i in group}
        moved, group = least != group, least
    assert len(set(group.values())) < len(group)
    assert values(after) == values(r for r in before if group[r["doc_id"]] == r["doc_id"])


def test_mix(stages):
    duckdb = pytest.importorskip("duckdb")
    before, after, _ = stages["mixing"]
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{stages['simhash_dedup'][2]}/*.parquet'")
    taken = dict(base.sql(f"SELECT doc_id, taken FROM ({LLM_SQL['op1_mixing']})").fetchall())
    words = {r["doc_id"]: WORD.findall(r["text"]) for r in before}
    used = Counter()
    for row in after:
        own = WORD.findall(row["text"])
        assert own == words[row["doc_id"]][: len(own)] and row["n_chars"] == len(row["text"])
        used[row["doc_id"]] += len(own)
    assert {i: n for i, n in taken.items() if n} == dict(used)


def test_packed_ids(stages):
    before, after, _ = stages["packing"]
    path = pipeline.tokenizer_path()
    whole = packing.tokenizer_of(path).tokenizer
    ids, pieces, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for row in before:
        ids[row["doc_id"]].append([*whole.encode(row["text"], add_special_tokens=False).ids, 1])
    for row in after:
        pieces[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append(row)
    assert pieces.keys() == ids.keys()
    for doc, copies in ids.items():
        assert Counter(x for r in pieces[doc] for x in r["ids"]) == Counter(x for copy in copies for x in copy)
        assert all(any(list(r["ids"]) == copy[r["start"] : r["start"] + r["length"]] for copy in copies) for r in pieces[doc])
    for placed in sequences.values():
        at = 0
        for row in sorted(placed, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= 2048
