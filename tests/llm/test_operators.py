"""Training-data operators on small tables: definitions by brute force, and nulls, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from calendar import isleap
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
import xxhash

from linkloom.llm import embedding_dedup, html_text, language_id, line_dedup, mixing, packing, pii, quality, simhash, suffix_dedup
from linkloom.llm.common import word_count
from linkloom.llm.components import connected_components
from linkloom.llm.queries import LLM_SQL

F = pytest.importorskip("pyspark.sql.functions")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _root string, size string"
COPY = "the quick brown fox jumps over the lazy dog and runs into the dark forest to hide from the hungry wolf until dawn breaks at last "
TEXTS = [
    None,
    "",
    "   \n\t\n ",
    "one",
    "!!! ??? 123",
    COPY * 3,
    COPY * 3,
    "unlike " + COPY + "more",
    "A shared line that is long enough\nown line one",
    "a SHARED line that is long enough  \nown line two\nA shared line that is long enough",
    "\ta shared line that is long enough\n",
    "été naïve — 日本語 \U0001f600 " * 40,
    "word " * 3000,
    "x" * 5000,
]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0, "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, TEXTS[8], None, None, None, None, None)], SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, docs):
    placed = mixing.curriculum(docs, word_count(F.col("text"))).collect()
    assert len(placed) == len(TEXTS) + 2
    per_source = defaultdict(list)
    for r in placed:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert all(0 <= p["position"] <= 1 for p in r["placements"])
        per_source[r["source"]].append(r)
    total = sum(r["size"] for r in placed)
    targets = {s: rows[0]["target"] for s, rows in per_source.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, rows in per_source.items():
        assert sum(r["taken"] for r in rows) == pytest.approx(targets[s], abs=1)
        assert targets[s] <= 3 * rows[0]["source_size"] + 1e-9


def test_mixing_positions_follow_the_schedule(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    placed = mixing.curriculum(rows, F.lit(1), schedules=[[(0.0, 0.0), (1.0, 1.0)]]).select("placements").collect()
    times = np.sort([p["position"] for r in placed for p in r["placements"]])
    assert len(times) == 4000
    assert np.abs(times - np.sqrt(np.arange(4000) / 4000)).max() < 1e-6


def test_mixed_documents_cut_at_the_quota(spark):
    rows = spark.createDataFrame([(1, " a  b c d e f ", "x"), (2, "g h i", "y")], "doc_id long, text string, source string")
    out = mixing.mixed_documents(rows, word_count(F.col("text")), weights=[1, 3]).collect()
    words = Counter(w for r in out for w in r["text"].split())
    assert sum(words[w] for w in "ghi") in (6, 7) and sum(words[w] for w in "abcdef") in (2, 3)


def test_line_dedup(docs):
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs).collect() if r["doc_id"] is not None}
    assert got[0]["n_lines"] == 1 and got[0]["kept_text"] == ""
    assert got[8]["kept_text"] == "own line one" and got[8]["n_dropped"] == 1
    assert got[9]["kept_text"] == "own line two" and got[9]["n_dropped"] == 2
    assert got[10]["n_dropped"] == 0 and got[10]["kept_text"] == TEXTS[10]
    assert got[11]["kept_text"] == TEXTS[11] and got[11]["_root"] == "clash"


def test_simhash_against_all_pairs(docs, spark):
    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        ones = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)) if grams else 0

    prints = {i: slow(t) for i, t in enumerate(TEXTS)}
    group = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            group[i] = min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    got = simhash.near_duplicates(docs).where("doc_id is not null").collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", group[i]) for i in prints}
    kept = [r["doc_id"] for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept) == sorted(i for i in prints if group[i] == i)


def test_fingerprint_links_of_a_crowded_shard(spark):
    random = np.random.default_rng(3)
    base = int(random.integers(0, 1 << 62))
    values = {base ^ sum(1 << int(b) for b in random.choice(64, random.integers(1, 6), replace=False)) for _ in range(5000)}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    roots = connected_components(simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), 4)).collect()
    sorted_values = np.array(signed, dtype=np.int64).view(np.uint64)
    lonely = sum((np.bitwise_count(sorted_values ^ v) <= 4).sum() == 1 for v in sorted_values)
    assert len(roots) == len(values) - lonely
    assert len({r["root"] for r in roots}) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    roots = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[1000 + i] for i in range(300)}) == 1
    assert roots[0] != roots[1000]


def test_suffix_dedup_against_brute_force(spark):
    random = np.random.default_rng(5)
    noise = lambda n: bytes(random.integers(97, 101, n).astype(np.uint8)).decode()
    shared = [noise(n) for n in (99, 100, 101, 140, 400, 3000)]
    texts = [noise(random.integers(0, 300)) + shared[random.integers(6)] + noise(random.integers(0, 300)) for _ in range(120)]
    texts += [texts[3], texts[3], "a" * 1000, "ab" * 400, "é" * 300, None, "", shared[4] * 3]
    texts += [t[:200] + "#" + t[201:] for t in texts[:20]]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = suffix_dedup.brute_force([(i, (t or "").encode()) for i, t in enumerate(texts)], 100)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in got} == want


def test_suffix_dedup_repeated_rows_lose_alike(docs):
    rows = suffix_dedup.remove_repeats(docs.where("doc_id = 5")).collect()
    assert len(rows) == 2 and rows[0] == rows[1]


def test_suffix_dedup_tells_texts_of_one_id_apart(spark):
    random = np.random.default_rng(6)
    noise = lambda n: bytes(random.integers(97, 123, n).astype(np.uint8)).decode()
    shared, seen = noise(300), {}
    while True:  # two texts of unlike length with one 16-bit checksum
        one = noise(150) if len(seen) % 2 else noise(900) + shared
        other = seen.setdefault(zlib.crc32(one.encode()) & 0xFFFF, one)
        if len(other) > len(one) or len(other) < len(one):
            break
    texts = [one, other, *(noise(200) for _ in range(300)), noise(150) + shared]
    rows = [(None, t) for t in texts] + [(1, shared), (7, "a" + texts[5]), (7, "b" + texts[5]), (7, "b" + texts[5])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # what follows the first in the order of (id, hash): a number for each different text of it
    order = sorted({(2**63 - 1 if i is None else i, np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64).item(), t) for i, t in rows})
    want = suffix_dedup.brute_force([(n, t.encode()) for n, (_, _, t) in enumerate(order)], 100)
    expected = Counter()
    for n, (i, _, t) in enumerate(order):
        expected[(None if i == 2**63 - 1 else i, *want[n])] += rows.count((None if i == 2**63 - 1 else i, t))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in got) == expected


def test_embeddings_against_all_pairs(spark):
    random = np.random.default_rng(1)
    base = random.normal(size=(60, 16))
    vectors = [(b + random.normal(size=16) * random.choice([0.05, 0.15, 0.4])).astype(np.float32) for b in base for _ in range(12)]
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(vectors)] + [(900, vectors[0].tolist(), 0), (901, vectors[0].tolist(), None)]
    odd = [(902, None, 1), (903, [], 1), (904, [0.0] * 16, 1), (905, [float("nan")] * 16, 1), (906, [1.0], 1), (907, [None, 1.0], 1)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    units = embedding_dedup.unit(np.array([r[1] for r in rows], dtype=np.float64))
    labels = np.array([-1 if r[2] is None else r[2] for r in rows])
    linked = (units @ units.T >= 0.98) & (labels[:, None] == labels) & (labels >= 0)
    np.fill_diagonal(linked, False)
    want, found = linked.sum(axis=1), np.array([got[r[0]]["n_links"] for r in rows])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert got[900]["component_id"] == 0 and not got[900]["kept"]
    for i in (901, *(r[0] for r in odd)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


@pytest.fixture(scope="module")
def tokenizer():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def test_packing_round_trip(docs, tokenizer):
    whole = packing.tokenizer_of(tokenizer).tokenizer
    rows = packing.pack(docs.where("doc_id is not null"), tokenizer, max_segments=4).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in enumerate(TEXTS):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1] * (1 + (i == 5))
        assert sorted(x for r in pieces[i] for x in r["ids"]) == sorted(ids)
        for r in pieces[i]:
            assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]]
    for placed in sequences.values():
        at = 0
        for r in sorted(placed, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len(placed) <= 4


def test_packing_keeps_to_all_limits():
    made = []
    packer = packing.Packer(lambda pieces: made.append(list(pieces)), 128, 3, 50, 4)
    random = np.random.default_rng(2)
    sizes = random.integers(1, 400, 200).tolist()
    for doc, n in enumerate(sizes):
        packer.add(packing.Piece(doc, 0, np.arange(n, dtype="<u4").tobytes(), n, int(random.integers(0, n + 1))))
    packer.finish()
    assert all(sum(map(len, s)) <= 128 and len(s) <= 3 and sum(p.loss for p in s) <= 50 for s in made)
    assert Counter(p.doc for s in made for p in s for _ in range(len(p))) == Counter({d: n for d, n in enumerate(sizes)})


def test_word_by_word_ids_equal_the_tokenizer(tokenizer):
    words = packing.tokenizer_of(tokenizer)
    text = "Don't STOP: İstanbul ß a_b x² ½ <|endoftext|>x a<|startoftext|>b é 日本 Σας «q» 1234  z \x1cq $%^'' fox.Über 'tis"
    assert words.ids(text.encode()) == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_texts_at_a_time_equal_the_tokenizer_text_by_text(tokenizer):
    random = np.random.default_rng(7)
    signs = list("aAzéÉßÿÀÞ×÷'sStre0139.,;<|>$\\1_-/ĀİſКж日é½¡¿") + ["e\u0301", "\xa0", "\x1c", "'ll", " ", "\n\t", "\x0b\x0c", "<|endoftext|>"]
    texts = ["".join(random.choice(signs, 40)).encode() for _ in range(400)] + [b"", b" \n", b"x" * 65, "é".encode() * 40, b"caf\xe9 \xff\xfea b\xc3"]
    words = packing.WordTokenizer(tokenizer)
    want = [words.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids for text in texts]
    for _ in range(2):  # the second time from what is kept
        assert [np.frombuffer(ids, "<u4").tolist() for ids in words.ids_of(texts)] == want
    assert b"".join(packing.ids_in_order(words, iter(texts))) == b"".join(words.ids_of(texts)) and words.ids_of([]) == []


def test_new_pieces_of_many_texts_go_to_the_merges_at_once(tokenizer):
    words, calls = packing.WordTokenizer(tokenizer), []
    merges = words.merges

    class Counted:
        def encode(self, *given, **options):
            calls.append(given)
            return merges.encode(*given, **options)

    words.merges = Counted()
    words.ids_of([b"Quobble, zantier! quobble", b"(vurmish) 42 Zantier", b"vurmish"])
    assert len(calls) == 1
    words.ids_of([b"vurmish quobble, (vurmish) QUOBBLE"])
    assert len(calls) == 1


def test_groups_of_texts_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 10)
    words, sizes = packing.WordTokenizer(tokenizer), []
    whole = words.ids_of
    words.ids_of = lambda texts: sizes.append(list(map(len, texts))) or whole(texts)
    texts = [b"one two", b"abc", b"a", b"far longer than a group", b"x"]
    assert list(packing.ids_in_order(words, texts)) == whole(texts)
    assert sizes == [[7, 3], [1], [23], [1]]


def test_language_needs_a_letter(spark, docs):
    given = "/root/testdata/sf0.001/documents.parquet"
    model = language_id.fit(spark.read.parquet(given), "text", "lang", F.col("doc_id"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 4)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5]["lang_pred"] == "en"
    seen = language_id.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model)
    assert seen.where("lang = lang_pred").count() >= 0.97 * seen.count()


def plain_features(text):
    """Bigram and trigram counts of the folded bytes in a dictionary, one gram at a time."""
    fold = lambda c: c + 32 if 65 <= c <= 90 or 0x80 <= c <= 0x9E else c if 97 <= c <= 122 or c >= 0x80 else 32
    folded = [32, *map(fold, text.encode()), 32]
    counts, low = Counter(), 2**32 - 1
    for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
        pair = (a * 2654435761 + b * 2246822519) & low
        if (a, b, c) != (32, 32, 32):
            counts[(((pair + c * 3266489917) & low) * 668265263 & low) >> 20] += 1
        counts[language_id.TRIGRAMS + ((pair * 374761393 & low) >> 22)] += 1
    blank = lambda *cs: sum(c * m for c, m in zip(cs, (2654435761, 2246822519, 3266489917), strict=False)) & low
    counts.pop((blank(32, 32, 32) * 668265263 & low) >> 20, None)
    counts.pop(language_id.TRIGRAMS + ((blank(32, 32) * 374761393 & low) >> 22), None)
    length = sum(counts.values()) ** 0.5
    return {place: n**0.5 / length for place, n in counts.items()}


def plain_duels(duels, features):
    wins, chances = Counter(), {}
    for (a, b), weights, bias in zip(duels.pairs, duels.weights, duels.biases, strict=True):
        chance = 1 / (1 + np.exp(-2 * (sum(float(weights[p]) * x for p, x in features.items()) + bias)))
        chances[a, b] = chance
        wins[a] += (chance > 0.5) + chance * 1e-3
        wins[b] += (chance <= 0.5) + (1 - chance) * 1e-3
    best = max(range(len(duels.names)), key=lambda n: (wins[n], -n))
    return duels.names[best], min([1.0] + [c if best == a else 1 - c for (a, b), c in chances.items() if best in (a, b)])


def test_languages_against_one_machine_at_a_time(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(given, "text", "lang", F.col("doc_id"))
    rows = language_id.identify(given.where("n_chars < 3000"), model).select("text", "lang_pred", "score").collect()
    assert len({r["lang_pred"] for r in rows}) > 2
    for r in rows[:80]:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert r["lang_pred"] == "und"
            continue
        features = plain_features(r["text"])
        family, sure = plain_duels(model.families, features)
        language, within = plain_duels(model.languages[family], features)
        assert r["lang_pred"] == language and abs(r["score"] - sure * within) < 1e-4


def test_language_without_labels(docs):
    model = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")), "text", "lang", F.col("doc_id"))
    assert model is None and {r[0] for r in language_id.identify(docs, model).select("lang_pred").collect()} == {"und"}


def test_pseudonyms(spark):
    text = (
        "card 4111111111111111, again 4111-1111-1111-1111; no card 4111111111111112. born 1984-02-29 or 02/30/1999, on 12/31/2001; "
        "call +1 (743) 555-3824 999 or +44 20 7946 0958, ssn 123-45-6789 not 666-45-6789; host 10.20.30.40. mail Ann.lee9@mail.example.com "
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" sha 24be64439e3e49cf46b2d7c90f3602a3d0b907ff v1.2.3.4.5'
    )
    rows = spark.createDataFrame([(1, text), (2, "4111111111111111"), (3, None), (4, ""), (5, "clean text 12 34")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows, "k").collect()}
    new = got[1]["text"]
    for value in ("4111111111111111", "4111-1111-1111-1111", "1984-02-29", "12/31/2001", "(743) 555-3824", "7946 0958", "123-45-6789", "10.20.30.40", "Ann.lee9@"):
        assert value not in new, value
    for value in ("4111111111111112", "02/30/1999", "666-45-6789", "sha 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "v1.2.3.4.5", " 999 or +44", "@mail.example.com"):
        assert value in new, value
    assert re.sub("[0-9A-Za-z]", "", new).replace("-", "") == re.sub("[0-9A-Za-z]", "", text).replace("-", "")
    card = got[2]["text"]
    assert card in new and card[0] == "4" and "-".join(re.findall("....", card)) in new
    digits = [int(c) for c in card][::-1]
    assert sum(digits[::2] + [2 * d - 9 * (d > 4) for d in digits[1::2]]) % 10 == 0
    assert got[3]["text"] is None and got[3]["n_found"] == 0 and got[4]["text"] == "" and got[5]["text"] == "clean text 12 34"


def plain_feistel(symbols, radices, kind, key):
    for number in range(pii.ROUNDS):
        others = ",".join(str(x) for j, x in enumerate(symbols) if j % 2 != number % 2)
        new = list(symbols)
        for i in range(number % 2, len(symbols), 2):
            drawn = hashlib.sha256(f"{key}|{kind}|{number}|{others}|{i}".encode()).hexdigest()[:12]
            new[i] = (symbols[i] + int(drawn, 16)) % radices[i]
        symbols = new
    return symbols


def plain_pseudonym(value, key):
    digits = [int(c) for c in value if c.isdigit()]
    filled = lambda new: re.sub(r"[0-9]", lambda m, it=iter(new): str(next(it)), value)
    if "@" in value:
        name, rest = value.split("@", 1)
        bases = [next((b for b, t in ((48, str.isdigit), (97, str.islower), (65, str.isupper)) if t(c)), None) for c in name]
        new = plain_feistel([ord(c) - b if b else 0 for c, b in zip(name, bases, strict=True)], [10 if b == 48 else 26 if b else 1 for b in bases], "email", key)
        return "".join(chr(b + x) if b else c for c, b, x in zip(name, bases, new, strict=True)) + "@" + rest
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        area, group, serial = (int(x) for x in value.split("-"))
        a, g, s = plain_feistel([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn", key)
        return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        day = date.fromisoformat(value)
        leap = isleap(day.year)
        years = [y for y in range(1900, 2100) if isleap(y) == leap]
        place, at = plain_feistel([years.index(day.year), day.timetuple().tm_yday - 1], [len(years), 365 + leap], "date", key)
        return (date(years[place], 1, 1) + timedelta(days=at)).isoformat()
    if re.fullmatch(r"[\d.]+\.\d+", value):
        return ".".join(map(str, plain_feistel([int(x) for x in value.split(".")], [256] * 4, "ip", key)))
    if value[0] in "+(" and not value.startswith("+4"):
        low = [2 if i in (0, 3) and d >= 2 else 0 for i, d in enumerate(digits[-10:])]
        radices = [10 if i not in (0, 3) else 8 if d >= 2 else 2 for i, d in enumerate(digits[-10:])]
        new = plain_feistel([d - s for d, s in zip(digits[-10:], low, strict=True)], radices, "phone", key)
        return filled(digits[:-10] + [x + s for x, s in zip(new, low, strict=True)])
    if value[0] == "+":
        return filled(digits[:2] + plain_feistel(digits[2:], [10] * (len(digits) - 2), "abroad", key))
    if re.search("[a-f]", value):
        return "".join(f"{x:x}" for x in plain_feistel([int(c, 16) for c in value], [16] * len(value), "key", key))
    body = [digits[0], *plain_feistel(digits[1:-1], [10] * (len(digits) - 2), "card", key)]
    total = lambda ds: sum(ds[::-1][::2] + [2 * d - 9 * (d > 4) for d in ds[::-1][1::2]])
    return filled(next([*body, c] for c in range(10) if total([*body, c]) % 10 == 0))


def test_pseudonyms_against_a_plain_feistel_network(spark):
    draw = np.random.default_rng(3)
    digit = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    values = ["4111111111111111", "4111-1111-1111-1111", "378282246310005", "10.0.255.1", "a@x.org", "Ann.lee9@mail.example.com", "+442079460958", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    values += [f"+1 ({digit(3)}) {digit(3)}-{digit(4)}" for _ in range(30)] + [f"{draw.integers(1, 666):03d}-{draw.integers(1, 100):02d}-{draw.integers(1, 10**4):04d}" for _ in range(20)]
    values += [(date(1900, 1, 1) + timedelta(days=int(n))).isoformat() for n in draw.integers(0, 73049, 60)] + ["2000-02-29", "1900-12-31", "2099-12-31", "1904-12-31"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.pseudonym(F.col("v"), "k").alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows} == {v: plain_pseudonym(v, "k") for v in values}


def test_dates_and_ssns_map_one_to_one(spark):
    days = spark.sql("select explode(sequence(date'1995-01-01', date'2004-12-31')) d").select(F.date_format("d", "yyyy-MM-dd").alias("v"))
    new = days.select(pii.pseudonym(F.col("v"), "k").alias("n"), F.try_to_date(pii.pseudonym(F.col("v"), "k")).alias("d"))
    count = days.count()
    assert new.select("n").distinct().count() == count and new.where("d between '1900-01-01' and '2099-12-31'").count() == count
    numbers = spark.range(1, 1000).select(F.format_string("%03d-12-3456", "id").alias("v"))
    ssn = numbers.select("v", pii.pseudonym(F.col("v"), "k").alias("n"))
    valid = "v not like '9%' and v not like '666%'"
    assert ssn.select("n").distinct().count() == 999 and ssn.where(valid).where("n rlike '^(000|666|9)|-00-|-0000$'").count() == 0


def test_no_planted_number_survives(spark):
    phones = ["+1 (017) 555-7713", "(117) 055-7713", "+14155550100", "+1 415 555 0100", "415 555 0100", "(415)5550100", "+1-015-155-0100", "+1 (415) 555-0101x12"]
    dates = ["2021-03-04T05:06", "2021-03-04t0506", "25/12/1999", "29/02/2000", "13/01/1900"]
    planted = phones + dates
    rows = spark.createDataFrame([(i, f"call {v}, or wait") for i, v in enumerate(planted)] + [(90, "30/02/1999 31/04/2001 32/01/2001")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows, "k").collect()}
    assert [(v, got[i]["n_found"], got[i]["n_replaced"]) for i, v in enumerate(planted)] == [(v, 1, 1) for v in planted]
    for i, v in enumerate(planted):
        assert re.sub("[0-9]", "0", got[i]["text"]) == re.sub("[0-9]", "0", f"call {v}, or wait")
    assert got[90]["n_replaced"] == 0
    linked = [re.sub(r"\D", "", got[i]["text"])[-10:] for i in (2, 3, 4, 5)]
    assert len(set(linked)) == 1


def test_given_phone_numbers_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = F.regexp_extract_all("text", F.lit(r"\+1 \(\d{3}\) \d{3}-\d{4}"), F.lit(0))
    made = pii.pseudonymise(docs.withColumn("_planted", planted), "k").where(F.size("_planted") > 0)
    rows = made.select("_planted", "text").collect()
    assert rows and not [v for r in rows for v in r["_planted"] if v in r["text"]]


def test_day_first_dates_and_odd_area_codes_map_one_to_one(spark):
    days = spark.sql("select explode(sequence(date'1999-01-01', date'2000-12-31')) d")
    strings = days.select(F.date_format("d", "dd/MM/yyyy").alias("v")).union(days.select(F.date_format("d", "MM/dd/yyyy"))).distinct()
    new = strings.select("v", pii.pseudonym(F.col("v"), "k").alias("n"))
    assert new.select("n").distinct().count() == new.count()
    assert new.where("substr(v, 1, 2) > '12'").where("try_to_date(n, 'dd/MM/yyyy') is null or substr(n, 1, 2) <= '12'").count() == 0
    numbers = spark.range(0, 1000).select(F.format_string("+1 (%03d) 155-0100", "id").alias("v"))
    phones = numbers.select(pii.pseudonym(F.col("v"), "k").alias("n"))
    assert phones.distinct().count() == 1000


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header>"
    "<nav><ul><li><a href=/>Menu</a></li></ul></nav><div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>"
    "\n text<br>goes on<p>Second &eacute;</article><aside>Side</aside><section id=comments><p>Nice!</p></section><footer>&copy; x</footer>"
)


def test_page_blocks():
    assert html_text.page_blocks(PAGE) == ["Head & more", "First bold text goes on", "Second é"]
    assert html_text.page_blocks("") == [] and html_text.page_blocks("plain <i>words</i> &am") == ["plain words &am"]
    assert html_text.page_blocks("<main><form>F</form><p>x</p></main><p>y</p>") == ["x"]


def test_attributes_and_raw_elements():
    page = (
        "<div style=\"overflow:hidden\" title='the hidden room'><p data-id=\"comments\">See <a href=\"/hidden-valley\">the valley</a> of x<math><mi>y</mi><mo/></math></p>"
        "<svg viewBox='0 > 1'/><object data=a /><iframe src=b/><p>on</p><div HIDDEN>h</div><p Class = 'x-ad'>b</p><svg><text>s</text></svg><iframe src=c><p>and on</p></div>"
    )
    assert html_text.page_blocks(page) == ["See the valley of xy", "on", "and on"]


def test_host_boilerplate_goes_and_copies_stay(spark):
    note = "Please subscribe to our weekly letter for more stories like this one today"
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8)]
    pages = [(i, f"https://a.example/{i}", f"<div><p>{t}</p><p>{note}</p></div>") for i, t in enumerate(own)]
    pages += [(20 + i, "http://b.example/", f"<p>{own[0]}</p>") for i in range(5)] + [(30, None, None), (31, "", "")]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages) and all(got[i]["text"] == own[i] for i in range(8))
    assert all(got[20 + i]["text"] == own[0] for i in range(5)) and got[30]["text"] == "" and got[31]["n_chars"] == 0


def test_repeated_runs_go_and_unique_ones_stay():
    line = "This page was last edited by our team of local writers on"
    own = [[" ".join(f"w{i}x{j}x{k}" for k in range(30)) for j in range(2)] for i in range(6)]
    pages = [[a, "Read more", "Share this", "one two three four", "five six seven eight", f"{line} d{i} May", b, "All rights reserved"] for i, (a, b) in enumerate(own)]
    got = html_text.without_boilerplate(pages, 8, 0.5, 3)
    assert got == [[a, f"d{i} May", b] for i, (a, b) in enumerate(own)]


def test_names_of_articles_are_no_noise():
    kept = ["<div id='ad-hoc-analysis'>a</div>", "<div class='social-security'>b</div>", "<div class='post related-work'>c</div>", "<p id='notice'>d</p>", "<h2 id=related>e</h2>"]
    gone = ["<div class='ad'>n</div>", "<div class='ad-slot-2 wide'>n</div>", "<section id='comments'>n</section>", "<div id=cookie-banner>n</div>", "<div class='Footer_Links'>n</div>"]
    assert html_text.page_blocks("".join(a + b for a, b in zip(kept, gone, strict=True))) == ["a", "b", "c", "d", "e"]


def test_short_articles_lose_a_long_menu_and_edited_copies_stay(spark):
    menu = " ".join(f"item{i}" for i in range(40))
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    pages = [(i, "https://a.example/", f"<div>{menu}</div><p>{t}</p>") for i, t in enumerate(own)]
    copies = [" ".join(f"e{i}x{j}" if j % 15 == 9 else f"c{j}" for j in range(90)) for i in range(4)]  # six edits each
    pages += [(10 + i, "https://b.example/", f"<p>{t}</p>") for i, t in enumerate(copies)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**dict(enumerate(own)), **{10 + i: t for i, t in enumerate(copies)}}


def test_quotations_stay_inside_a_paragraph():
    said = "to be or not to be that is the question"
    pages = [[f"{' '.join(f'w{i}x{j}' for j in range(20))} {said} {' '.join(f'v{i}x{j}' for j in range(20))}"] for i in range(6)]
    assert html_text.without_boilerplate(pages, 8, 0.5, 3) == pages


def plain_boilerplate(pages, run, share, least):
    """The same by lists of words: strings as tuples, pages one by one."""
    short, needed = min(run, 4), max(least, -(-len(pages) * share // 1))
    holders = defaultdict(set)
    for n, page in enumerate(pages):
        words = " ".join(page).split()
        for size in {short, run}:
            for at in range(len(words) - size + 1):
                holders[tuple(words[at : at + size])].add(n)
        for block in page:
            if len(block.split()) < short:
                holders["block", block].add(n)
    common = {string for string, on in holders.items() if len(on) >= needed}
    made = []
    for page in pages:
        words = " ".join(page).split()
        cover = {size: set() for size in (short, run)}
        for size, places in cover.items():
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in common:
                    places.update(range(at, at + size))
        at, kept, own = 0, [], [False] * len(words)
        for block in page:
            places = list(range(at, at + len(block.split())))
            at += len(places)
            if all(p in cover[short] | cover[run] for p in places) or (len(places) < short and ("block", block) in common):
                continue
            for p in places:
                own[p] = p not in cover[run]
            while places[0] in cover[run]:
                places.pop(0)
            while places[-1] in cover[run]:
                places.pop()
            kept.append(" ".join(words[p] for p in places))
        stretch = max(map(len, "".join("x" if o else " " for o in own).split()), default=0)
        made.append(kept if stretch >= run else page)
    return made


@pytest.mark.parametrize("seed", range(25))
def test_boilerplate_against_lists(seed):
    draw = np.random.default_rng(seed)
    shared = [" ".join(f"s{n}x{j}" for j in range(draw.integers(1, 14))) for n in range(5)]
    fresh = iter(range(10**6))
    pages = []
    for _ in range(draw.integers(1, 9)):
        page = []
        for _ in range(draw.integers(1, 7)):
            parts = [shared[draw.integers(5)] if draw.random() < 0.5 else " ".join(f"o{next(fresh)}" for _ in range(draw.integers(1, 12))) for _ in range(draw.integers(1, 4))]
            page.append(" ".join(parts))
        pages.append(page)
    assert html_text.without_boilerplate(pages, 8, 0.5, 3) == plain_boilerplate(pages, 8, 0.5, 3)


def test_large_host_is_judged_as_a_whole(spark):
    often = "the letter of the day comes to you by mail each morning at six"
    seldom = "a special offer for all the readers of this section ends this week"
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(300)]
    notes = [[often] * (i < 150) + [seldom] * (i >= 151) for i in range(300)]  # on exactly half of the pages and on one less
    pages = [(i, f"https://a.example/{i}", "".join(f"<p>{x}</p>" for x in [own[i], *notes[i]])) for i in range(300)]
    got = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: "\n\n".join([own[i], *[n for n in notes[i] if n == seldom]]) for i in range(300)}


def test_quality(docs):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (len(words), len(repeated))
        assert got[i]["word_chars"] == sum(map(len, words)) and got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_bad_hosts_go_and_small_ones_shrink(spark):
    good, bad = "".join(f"w{i} " for i in range(80)), "short"
    rows = [(i, good, "a") for i in range(50)] + [(100 + i, bad if i else good, "b") for i in range(50)] + [(200, bad, "c"), (201, good, "c")]
    rows += [(300 + 10 * h + i, good if i else bad, f"h{h}") for h in range(20) for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and not got[100] and got[201] and got[301]


def test_host_verdicts_against_the_sql_form(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    good = "".join(f"w{i} " for i in range(80))
    kinds = {"short": "few words", "symbols": good + "#*$%&|<>" * 60, "lines": good + "\nsame line\nsame line\nsame line", "good": good}
    shares = {"a": ("good", 0), "b": ("short", 45), "c": ("symbols", 40), "d": ("lines", 48), "e": ("short", 10), "f": ("lines", 20), None: ("symbols", 50)}
    rows = [(i + 100 * n, kinds[kind if i < bad else "good"], host) for n, (host, (kind, bad)) in enumerate(shares.items()) for i in range(50)]
    rows.append((9999, None, "a"))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(spark.read.parquet(path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = {r[0]: (r[1], r[2]) for r in db.sql(f"SELECT doc_id, base_failed, kept FROM ({LLM_SQL['op9_quality']})").fetchall()}
    assert got == want
    lost = {host for _, (i, _, host) in enumerate(rows) if not got[i][0] and not got[i][1]}
    assert {"c", "d"} <= lost and not {"a", "e"} & lost


def test_empty_tables(spark, empty, tokenizer):
    size = word_count(F.col("text"))
    made = [
        mixing.curriculum(empty, size),
        mixing.mixed_documents(empty, size),
        language_id.identify(empty, language_id.fit(empty, "text", "lang", F.col("doc_id"))),
        suffix_dedup.remove_repeats(empty),
        embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
        packing.pack(empty, tokenizer),
        pii.pseudonymise(empty, "k"),
        html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")),
        line_dedup.drop_repeated_lines(empty),
        quality.judge(empty),
        simhash.near_duplicates(empty),
        simhash.deduplicated(empty),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline

    table = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, "/root/testdata/sf0.001")
        if name == "packing":
            assert out.count() >= 1
        else:
            assert out.columns == docs.columns
            table = out
    kept = {r["doc_id"] for r in table.collect()}
    assert 0 not in kept and 4 not in kept and 11 in kept


CLASHES = (
    "score size target taken placements n_lines n_dropped kept_text lang_pred source_size slot _id _fp _n _f _s _slot _source _placed _made "
    "_losses _losing _root fingerprint component_id _size _spread _bucket _start _rest _key label features"
).split()


def test_pipeline_stages_keep_the_values_of_clashing_columns(spark, docs):
    import corpus_pipeline

    plain = docs.drop("_root", "size").where("doc_id is not null").dropDuplicates(["doc_id"])
    table = plain.select("*", *[F.concat(F.lit(f"{name} "), "doc_id").alias(name) for name in CLASHES], F.lit(1).alias("a.b"))
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = stage(spark, table, "/root/testdata/sf0.001")
        assert table.columns == columns, name
        rows = table.collect()
        assert rows, name
        for r in rows:
            assert [r[c] for c in CLASHES] == [f"{c} {r['doc_id']}" for c in CLASHES] and r["a.b"] == 1, name
        table = spark.createDataFrame(rows, table.schema)


def test_pipeline_languages_follow_sure_predictions(spark):
    import corpus_pipeline

    english = "the cat and the dog are with him and her, that is what they have this was "
    french = "les chats et les chiens sont dans le jardin avec elle, une maison pour vous est "
    rows = [(i, (english if i % 2 else french) * (i % 4 + 2), "en" if i % 2 else "fr", "s", 0) for i in range(200)]
    wrong = [(1000, english * 3, "fr", "s", 0), (1001, french * 3, None, "s", 0), (1002, "123", "en", "s", 0)]
    docs = spark.createDataFrame(rows + wrong, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_languages(spark, docs, "").collect()}
    assert got[1000] == "en" and got[1001] == "fr" and 1002 not in got and got[1] == "en" and got[2] == "fr"
