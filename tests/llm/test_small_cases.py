"""Each operator against brute force on small documents: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statloom.llm import (
    _shared,
    byte_cnn,
    collision_search,
    components,
    hypergeometric_sharding,
    risk_thresholds,
    separator_scan,
    simhash_dedup,
    slack_packing,
    substring_dedup,
    systematic_mixing,
    temporal_list_join,
    tokenizing,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def texts() -> list:
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    sentence = lambda n: " ".join(rng.choice(words, n))
    passage, long_ = sentence(60), sentence(6000)
    base = sentence(120)
    near = base.split()
    near[5] = "changed"
    return [
        None, "", "  \n\t ", "one", "Two words", base, base, " ".join(near), base.upper(), f"{sentence(30)} {passage}\n{sentence(10)}", f"{passage} {sentence(40)}",
        f"{passage}\n{passage} end", long_, f"{long_} tail", "x " * 3000, "it's 12,5 ÀÉ ﬁ x́y <|endoftext|> 漢字  z", "é" * 50, sentence(20), "### $$$ " * 30,
    ]


def documents(spark, extra: bool = False):
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "a", "b", "B", "é")[i % 5], None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [rows[5], (None, "no id here", None, None, 10), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("row", "key", "size", "shard", "slot", "packed", "copies", "fingerprint", "stratum", "c", "class", "slice", "text_hash", "root"):
            df = df.withColumn(name, F.lit("own"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (9, None, 0), (18, 0, 1)], "doc_id long, quality int, toxic int")


def words(text) -> list[str]:
    return WORD.findall(text or "")


# --- 1, 9: tokens ------------------------------------------------------------------------


PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole_ids(text) -> list[int]:
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_words_alone_give_the_ids_of_texts():
    tokenizer = tokenizing.WordTokenizer()
    for text in [*texts(), "don't-stop'LL _a_b 'tis ﬀ İstanbul ΣΑΣ ẞß ÿŸ ×÷ a\x1cb \x85c １²½", "A.B c++ (d) [e] é.È,", "a" * 300,
                 "hello <|endoftext|> there", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|>"]:
        assert np.frombuffer(tokenizer.encode((text or "").encode()), "<u4").tolist() == whole_ids(text)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED_BYTES", 20_000)
    tokenizer = tokenizing.WordTokenizer.of_worker()
    text = " ".join([f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}q x{i}" for i in range(3000)] + ["y" * 100_000, "z" * 65, "z" * 65])
    assert np.frombuffer(tokenizer.encode(text.encode()), "<u4").tolist() == whole_ids(text)
    assert 20_000 <= tokenizer.known.held <= 21_000 and len(tokenizer.known) < 110 and max(map(len, tokenizer.known)) <= 64
    assert tokenizing.WordTokenizer.of_worker() is tokenizer and len(tokenizer.known) == 0


def test_ids_of_any_characters():
    tokenizer, rng = tokenizing.WordTokenizer(), np.random.default_rng(15)
    signs = [chr(c) for c in range(256)] + list("\'\'sstmdlve  ..\u2019\u201c\u00e9\u0301\u0130\u03a3\u4e2d\ufb01") + ["<|endoftext|>", "\'re", "\'ll"]
    for _ in range(1500):
        text = "".join(rng.choice(signs, rng.integers(1, 30)))
        assert np.frombuffer(tokenizer.encode(text.encode()), "<u4").tolist() == whole_ids(text), repr(text)


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_separator_scan_counts_tokens(spark, docs, block):
    found = separator_scan.token_counts(documents(docs.sparkSession, extra=True), block_ids=block).collect()
    expected = sorted((str(r["doc_id"]), len(whole_ids(r["text"]))) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == expected
    assert separator_scan.token_counts(docs.where("false")).count() == 0


def test_separator_scan_takes_any_ids_and_wide_vocabularies(spark):
    df = spark.createDataFrame([(1.5, "one two"), (2.5, None)], "doc_id double, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in separator_scan.token_counts(df).collect()} == {1.5: 2, 2.5: 0}
    wide = separator_scan.flat_blocks(df, 4, width=4)
    found = separator_scan.find_separators(wide, separator_scan.separator_of(4), 4)
    assert sorted(r["n_tokens"] for r in separator_scan.documents_in(found.cache()).collect()) == [0, 2]


def test_separator_scan_of_flat_files(spark, tmp_path):
    ids = [5, 6, 9, 9, 7, 9, 8, 8, 8, 8, 8, 9, 3, 3]
    (tmp_path / "f.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    for size in (2, 6, 100):
        blocks = separator_scan.blocks_of_files(spark, str(tmp_path), size)
        found = separator_scan.documents_in(separator_scan.find_separators(blocks, 9).cache()).orderBy("ordinal").collect()
        assert [(r["start"], r["n_tokens"], r["terminated"]) for r in found] == [(0, 2, True), (3, 0, True), (4, 1, True), (6, 5, True), (12, 2, False)]
    none = blocks.where("false")
    assert separator_scan.documents_in(separator_scan.find_separators(none, 9)).count() == 0


def test_packing_is_exact(docs):
    packed = slack_packing.pack_documents(documents(docs.sparkSession, extra=True), capacity=64).cache()
    found = packed.withColumn("ids_crc32", F.crc32("ids")).collect()
    expected = []
    for r in docs.collect():
        ids = [*whole_ids(r["text"]), 0]
        for i in range(0, len(ids), 64):
            part = ids[i : i + 64]
            expected.append((str(r["doc_id"]), i // 64, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(expected)
    bins: dict = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(e[3] for e in expected) // 64) + 1
    whole = {r["sequence_id"]: r["ids"] for r in slack_packing.sequences(packed).collect()}
    assert set(whole) == set(bins)
    for r in found:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]
    assert slack_packing.pack_documents(docs.where("false")).count() == 0


def test_fullest_combination():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 40, 6)}
        found = slack_packing.fullest(counts, 40)
        assert all(found[n] <= counts[n] for n in found) and max(counts) in found
        best = 0
        sums = {max(counts)}
        for n, c in counts.items():
            for _ in range(c - (n == max(counts))):
                sums |= {s + n for s in sums if s + n <= 40}
        best = max(sums)
        assert sum(n * m for n, m in found.items()) == best


# --- 2: SimHash ----------------------------------------------------------------------------


def plain_simhash(text) -> int:
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int], names: list, radius: int = 2) -> list:
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, n in zip(group, names, strict=True):
        if n is not None:
            least[g] = min(least.get(g, n), n)
    return [least.get(g) for g in group]


def test_simhash_classes(docs):
    rows = docs.collect()
    values = [plain_simhash(r["text"]) for r in rows]
    expected = zip([r["doc_id"] for r in rows], [f"{v:016x}" for v in values], plain_components(values, [r["doc_id"] for r in rows]), strict=True)
    found = simhash_dedup.near_duplicate_classes(docs).collect()
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in found)
    assert simhash_dedup.near_duplicate_classes(docs.where("false")).count() == 0


def test_links_of_chains_and_crowds(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**62))
    values = {centre}
    x = centre
    for b in range(40):  # a chain, each two bits from the last
        x ^= 1 << b | 1 << (63 - b % 20)
        values.add(x)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)}
    values |= {int(v) for v in rng.integers(0, 2**63, 200)}
    listed = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in listed], "fingerprint long")
    found = {r["fingerprint"] & (2**64 - 1): r["root"] for r in simhash_dedup.classes(df).collect()}
    expected = plain_components(listed, list(range(len(listed))))
    pairs = {(found[v], e) for v, e in zip(listed, expected, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and len(found) == len(listed)
    for shard_rows, most in ((64, 200), (16, 20)):  # crowded shards are dealt anew, and get several trees
        edges = [(r["src"] & (2**64 - 1), r["dst"] & (2**64 - 1)) for r in simhash_dedup.links(df, 2, shard_rows, most).collect()]
        assert all(bin(a ^ b).count("1") <= 2 for a, b in edges)
        label = np.arange(len(listed))
        place = {v: i for i, v in enumerate(listed)}
        simhash_dedup.hooked(label, *(np.array([place[e[i]] for e in edges]) for i in (0, 1)))
        assert {(a, b) for a, b in zip(label.tolist(), expected, strict=True)} == {(b, b) for b in expected}
        members = simhash_dedup.sharded(df, 2, shard_rows, most).where("member").groupBy("shard").count().agg(F.max("count")).first()[0]
        assert members <= 2 * most


def test_trees_follow_and_skip_edges():
    rng = np.random.default_rng(9)
    values = np.unique(np.r_[rng.integers(0, 2**63, 3000), np.arange(40) << 20].astype(np.uint64))
    tree = simhash_dedup.BKTree(values)
    parents, distances = np.nonzero(tree.child >= 0)
    assert sorted(tree.child[parents, distances].tolist()) == list(range(1, len(values)))  # every member has one place
    assert (np.bitwise_count(values[parents] ^ values[tree.child[parents, distances]]) == distances).all()
    found = {(int(a), int(b)) for asked, near in tree.within(values, 2) for a, b in zip(asked, near, strict=True)}
    away = np.bitwise_count(values[:, None] ^ values[None, :])
    assert found == set(zip(*(x.tolist() for x in np.nonzero(away <= 2)), strict=True))
    edges = len(values) * (len(values) - 1)
    assert 0.001 * edges < tree.followed < 0.05 * edges  # edges followed by all queries, of all edges


def test_long_texts_are_hashed_whole(monkeypatch):
    text = "\n".join(" ".join(f"w{i * j % 997}" for i in range(50)) for j in range(40))
    whole = plain_simhash(text)
    monkeypatch.setattr(simhash_dedup, "pieces_of", lambda t: _shared.pieces_of(t, 30))
    assert simhash_dedup.simhash(text.encode()) == whole
    assert simhash_dedup.simhash(b" one  two ") == plain_simhash("one two") and simhash_dedup.simhash(b" \n ") == 0
    pieces = list(_shared.pieces_of(text.encode(), 30))
    assert b"".join(pieces) == text.encode() and sum(len(p.split()) for p in pieces) == 2000


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    found = {r["vertex"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_one_of_each_class_stays(spark, docs):
    kept = simhash_dedup.keep_one_of_each(documents(spark, extra=True))
    assert kept.columns == documents(spark, extra=True).columns
    rows = docs.collect()
    groups = plain_components([plain_simhash(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    expected = sorted({g for g in groups if g is not None})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == expected
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["no id here"]


# --- 3: substrings ------------------------------------------------------------------------


def plain_removals(rows: list, n: int = 20) -> list:
    first, out = {}, []
    ranks: dict = {}

    def rank(i, text):  # rows without doc_id come last, each text a document of its own
        return (1, ranks[text or ""]) if i is None else (0, i)

    unnamed = sorted({t or "" for i, t in rows if i is None}, key=lambda t: spark_hash(t))
    ranks.update({t: k for k, t in enumerate(unnamed)})
    for doc_id, text in rows:
        found = words(text)
        for s in range(len(found) - n + 1):
            window = tuple(found[s : s + n])
            first[window] = min(first.get(window, (rank(doc_id, text), s)), (rank(doc_id, text), s))
    for doc_id, text in rows:
        found = words(text)
        gone = set()
        for s in range(len(found) - n + 1):
            if first[tuple(found[s : s + n])] < (rank(doc_id, text), s):
                gone.update(range(s, s + n))
        kept = [w for i, w in enumerate(found) if i not in gone]
        out.append((str(doc_id), len(found), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def spark_hash(text: str) -> int:
    """Spark's xxhash64 of a string, as the order of rows without doc_id takes it."""
    return xxhash.xxh64_intdigest(text.encode(), 42) % (1 << 61)


@pytest.mark.parametrize("batches", [1, 4])
def test_repeated_windows_go(docs, batches):
    found = substring_dedup.removal_digest(docs, batches=batches).collect()
    expected = plain_removals([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == expected
    assert substring_dedup.removal_digest(docs.where("false")).count() == 0


def test_index_is_opened_again(spark, docs, tmp_path):
    """Two sessions' batches (history, then new documents) give what all documents together give."""
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    expected = plain_removals(rows)
    path, found = f"file://{tmp_path}/index", []
    for low, high in ((0, 7), (7, 12), (12, 14), (14, 1000)):
        part = docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        out = substring_dedup.removal_digest(part, batches=2, index=path, history=docs.where(F.col("doc_id") < low))
        found += [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()]
        for table in spark.catalog.listTables():  # as in a new session, which knows the folder alone
            if table.name.startswith("statloom_"):
                spark.sql(f"DROP TABLE {table.name}")
    assert sorted(found) == expected
    index = substring_dedup.FingerprintIndex(spark, path)
    sizes = [index._table(run).count() for run in index.runs]
    assert sizes and all(sizes[i] > substring_dedup.TIER * sum(sizes[i + 1 : -1]) for i in range(len(sizes) - 2))
    before = index.runs
    with pytest.raises(Exception):
        substring_dedup.repeats(docs.select("doc_id", F.expr("raise_error('x')").cast("string").alias("text")), index)
    assert index.pending is None and substring_dedup.FingerprintIndex(spark, path).runs == before
    index.drop()
    assert not (tmp_path / "index").exists()


def test_a_long_history_is_not_written_again_for_small_batches(spark, tmp_path):
    rng = np.random.default_rng(21)
    text = lambda n: " ".join(f"w{rng.integers(10**6)}" for _ in range(n))
    passage = text(40)
    rows = [(i, text(400) + (" " + passage if i == 5 else "")) for i in range(40)] + [(100 + i, text(60) + (" " + passage if i > 3 else "")) for i in range(6)]
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", 4)
    batches = [spark.createDataFrame(part, "doc_id long, text string") for part in (rows[:40], rows[40:42], rows[42:44], rows[44:46])]
    first, found = None, []
    for batch in batches:
        rows_found, _ = substring_dedup.repeats(batch, index, batches=1)
        found += [(r["key"], x["old_key"]) for r in rows_found.collect() for x in r["found"]]
        first = first or index.runs[0]
    assert index.runs[0] == first and 2 <= len(index.runs) <= 3  # the large run is still the one written first
    assert {k for k, _ in found} == {104, 105} and {o for _, o in found} <= {5, 104}  # an earlier place, not always the first
    index.compact()
    assert len(index.runs) == 2 and index.runs[0] == first
    index.drop()


def test_documents_are_read_once_for_digests_and_once_a_batch(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(30)) + (f" {passage}" if i % 3 == 0 else "")) for i in range(60)]
    docs, read = spark.createDataFrame(rows, "doc_id long, text string"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = substring_dedup.removal_digest(docs.mapInArrow(counted, docs.schema), batches=3).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == plain_removals(rows)
    assert read.value <= 6 * len(rows)  # digests, three batches, the check of repeats and the words that stay


def test_windows_are_ordered_by_runs():
    rng = np.random.default_rng(8)
    for keys, n in ((1000, 40), (3, 40), (2, 7)):  # few keys: rows of equal key, whose runs overlap
        key = np.repeat(rng.integers(-keys, keys, 50), n)
        start = np.tile(np.arange(n), 50) + np.repeat(rng.integers(0, 9, 50), n)
        h = np.repeat(rng.integers(-20, 20, 50 * n), rng.integers(1, 9, 50 * n))[: 50 * n]
        check = rng.integers(-(1 << 31), 1 << 31, 50 * n).astype(np.int32)
        found = substring_dedup.in_order(h, check, key, start)
        order = np.lexsort((start, key, h))
        assert all((a == b[order]).all() for a, b in zip((found[0], *found[2:]), (h, key, start), strict=True))
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(zip(h.tolist(), check.tolist(), key.tolist(), start.tolist(), strict=True))


def test_words_of_a_text_joined(monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 16)  # read in pieces
    text = b" \x0b a bb\t\nccc " + b" " * 40 + "d\u00e9 e\u00a0f".encode() + b" gg" * 9 + b"\r"
    found, ws = substring_dedup.Spaced(text), text.split()
    assert (found.text, found.n) == (b" ".join(ws), len(ws)) and found.said(2, 5) == b" ".join(ws[2:5]) and found.said(0, found.n) == found.text
    check = lambda a, n, d=None: {"start": a, "words": n, "digest": xxhash.xxh3_128_digest(d or b" ".join(ws[a : a + n]))}
    gone = found.gone([check(1, 2), check(2, 3), check(6, 2, b"other"), check(len(ws) - 1, 2)], False, 20)
    assert gone.nonzero()[0].tolist() == [1, 2, 3, 4]
    assert list(found.kept(gone)) == [ws[0], b" ".join(ws[5:])] and list(found.kept(gone | True)) == [] and list(found.kept(gone & False)) == [found.text]
    empty = substring_dedup.Spaced(b" \n ")
    assert (empty.text, empty.n) == (b"", 0) and list(empty.kept(empty.gone(None, False, 20))) == [] and not empty.gone(None, True, 20).any()
    lists = pa.array([None, [], [check(1, 2)], None, [check(0, 1), check(3, 1)]], pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())])))
    assert list(substring_dedup.checks_of(lists)) == [[], [], [check(1, 2)], [], [check(0, 1), check(3, 1)]]
    assert list(substring_dedup.checks_of(lists[2:])) == [[check(1, 2)], [], [check(0, 1), check(3, 1)]]


def test_repeats_are_verified_by_their_words(spark):
    same = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, same), (2, "x " + same), (3, "y " + same.replace("w7", "v7"))], "doc_id long, text string")
    claimed = spark.createDataFrame([(2, [(i + 1, 1, i) for i in range(11)]), (3, [(i + 1, 1, i) for i in range(11)])], "key long, found array<struct<start:int,old_key:long,old_start:int>>")
    stretches = substring_dedup.stretches_of(claimed, 20)
    assert sorted((r["key"], r["start"], r["words"], r["old_start"]) for r in stretches.collect()) == [(2, 1, 30, 0), (3, 1, 30, 0)]
    checks = {r["key"]: [x.asDict() for x in r["checks"]] for r in substring_dedup.verified(stretches, docs).collect()}
    gone = {i: substring_dedup.removed_words(t.encode(), checks.get(i), False, 20)[2].sum() for i, t in ((2, "x " + same), (3, "y " + same.replace("w7", "v7")))}
    assert gone == {2: 30, 3: 0}


def test_windows_of_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(13)
    text = " \n".join(rng.choice([f"w{i}" for i in range(50)], 900)).encode()
    whole = [(r, s) for group in substring_dedup._parts(pa.array([text, None, text]), 20) for r, b, t in group for s in [(b, t)]]
    assert len(whole) == 2 and whole[0] == (0, (0, text))
    one = substring_dedup.Words([text]).windows(20, 10)
    monkeypatch.setattr(substring_dedup, "GROUP", 300)
    seen: dict = {}
    for group in substring_dedup._parts(pa.array([text]), 20):
        found = substring_dedup.Words([t for _, _, t in group])
        at, h, check = found.windows(20, 10)
        base = np.array([b for _, b, _ in group])
        for w, x, c in zip(at, h, check, strict=True):
            place = int(base[found.text[w]] + w - found.first[found.text[w]])
            assert place not in seen
            seen[place] = (x, c)
    assert seen == {int(w): (x, c) for w, x, c in zip(*one, strict=True)} and len(seen) == 881


def test_texts_without_repeats(spark):
    docs = documents(spark, extra=True)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    kept = sorted((str(r["doc_id"]), hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in out.collect())
    assert kept == sorted((d, s) for d, _, _, s in plain_removals([(r["doc_id"], r["text"]) for r in docs.collect()]))
    for r in out.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["packed"] == "own"


# --- 4: lists -------------------------------------------------------------------------------


def test_lists_as_of_fetch_time(spark):
    entries = spark.createDataFrame(
        [("bad.com", "add", 10), ("bad.com", "remove", 20), ("bad.com", "add", 30), ("a.bad.com", "add", 15), ("tie.com", "add", 5), ("tie.com", "remove", 5), (None, "add", 1), ("x.com", "add", None)],
        "domain string, action string, at long",
    )
    cases = [
        ("http://bad.com/x", 9, None), ("http://bad.com/x", 10, "bad.com"), ("https://u@BAD.com:80/?q", 19, "bad.com"), ("http://bad.com", 20, None), ("http://www.bad.com.", 30, "bad.com"),
        ("http://a.bad.com/", 16, "a.bad.com"), ("http://a.bad.com/", 25, "a.bad.com"), ("http://notbad.com/", 35, None), ("http://tie.com", 6, None), (None, 5, None), ("nohost", 5, None), ("http://bad.com", None, None),
    ]
    captures = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(cases)], "id int, url string, fetched_at long")
    found = {r["id"]: (r["listed"], r["entry"]) for r in temporal_list_join.listed_captures(captures, entries).collect()}
    assert found == {i: (e is not None, e) for i, (_, _, e) in enumerate(cases)}
    assert temporal_list_join.listed_captures(captures, entries.where("false")).where("listed").count() == 0


def test_lists_with_clashing_columns_repeats_and_long_urls(spark):
    entries = spark.createDataFrame([("bad.com", "add", 10), ("late.org", "add", 10**12)], "domain string, action string, at long")
    rows = [("http://bad.com/" + "x" * 200_000, 2 * 10**8), ("http://bad.com/", 11), ("http://bad.com/", 11), ("http://late.org", 99), (None, None)]
    captures = spark.createDataFrame(rows, "url string, fetched_at int")
    names = ("spans", "row", "at", "span", "hit", "domain", "host", "listed", "entry", "since", "until")
    for name in names:
        captures = captures.withColumn(name, F.lit("own"))
    found = temporal_list_join.listed_captures(captures, entries)
    assert sorted(found.columns) == sorted(captures.columns) and found.count() == 5
    assert sorted([(r["fetched_at"] or 0, r["host"], r["listed"], r["entry"], r["since"], r["spans"], r["row"]) for r in found.collect()], key=repr) == sorted(
        [(2 * 10**8, "bad.com", True, "bad.com", 10, "own", "own"), (11, "bad.com", True, "bad.com", 10, "own", "own"), (11, "bad.com", True, "bad.com", 10, "own", "own"),
         (99, "late.org", False, None, None, "own", "own"), (0, None, False, None, None, "own", "own")], key=repr)
    assert temporal_list_join.listed_captures(captures.where("false"), entries).count() == 0


def test_times_may_be_anything(spark):
    """Against holding each capture against each interval: the first and last long, milliseconds, the year 9999, negative times."""
    rng = np.random.default_rng(12)
    odd = [2**63 - 1, -(2**63), 1_704_067_200_000, 253_402_300_799, -1, 0, 1, temporal_list_join.SPAN, -temporal_list_join.SPAN, temporal_list_join.SPAN - 1]
    names = ["a.org", "x.a.org", "b.net", "c.d.e.com", "e.com"]
    time = lambda: int(rng.choice(odd)) if rng.uniform() < 0.4 else int(rng.integers(-(10**8), 2 * 10**9))
    listed = [(str(rng.choice(names)), str(rng.choice(["add", "remove"])), time()) for _ in range(120)]
    asked = [(i, "http://" + str(rng.choice(["", "www."])) + str(rng.choice(names)) + "/p", time()) for i in range(400)]
    entries, captures = spark.createDataFrame(listed, "domain string, action string, at long"), spark.createDataFrame(asked, "id int, url string, fetched_at long")
    spans = {}
    for domain in names:
        own = sorted((at, action) for d, action, at in listed if d == domain)
        spans[domain] = [(at, own[i + 1][0] if i + 1 < len(own) else None) for i, (at, action) in enumerate(own) if action == "add"]
    expected = {}
    for i, url, at in asked:
        host = url.split("/")[2]
        hits = [(len(d), d, since) for d, own in spans.items() if host == d or host.endswith("." + d) for since, until in own if since <= at and (until is None or at < until)]
        expected[i] = max(hits)[1:] if hits else (None, None)
    found = {r["id"]: (r["entry"], r["since"]) for r in temporal_list_join.listed_captures(captures, entries).collect()}
    assert found == expected and sum(e is not None for e, _ in expected.values()) > 50


def test_a_far_time_does_not_multiply_the_list(spark):
    entries = spark.range(200).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".org")).alias("domain"), F.lit("add").alias("action"), F.lit(10).alias("at"))
    pairs = spark.createDataFrame([("d1.org", s) for s in (0, 5, 3 * 10**12)], "domain string, span long")
    rows = temporal_list_join.intervals_by_span(temporal_list_join.validity(entries), pairs)
    assert rows.count() == 200 + 2 and rows.where("domain = 'd1.org'").count() == 3


# --- 5: neighbours -----------------------------------------------------------------------------


def test_neighbours_against_all(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(600, 16)).round(3)
    vectors[100:180] = vectors[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (1200, [1.0] * 3), (None, [1.0] * 16), (1250, []), (50, vectors[50].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = {}
    for r in collision_search.nearest_neighbours(df, shard_rows=150).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    v = vectors.astype(np.float32).astype(float)
    norm = np.sqrt((v * v).sum(axis=1))
    right = 0
    for q in range(0, 600, 50):
        cos = (v * v[q]).sum(axis=1) / (norm * norm[q])
        cos[q] = -9
        best = np.lexsort((np.arange(600), -cos))[:5]
        right += len({x for x, _ in found[q].values()} & set(best.tolist()))
        assert sorted(found[q]) == [1, 2, 3, 4, 5] and all(s == pytest.approx(cos[x]) for x, s in found[q].values())
    assert set(found) == set(range(0, 600, 50)) and right >= 0.9 * 60
    assert [found[100][r][0] for r in range(1, 6)] == [101, 102, 103, 104, 105]
    few = collision_search.nearest_neighbours(df.where("vec_id < 3"))
    assert [(r["query_id"], r["rank"]) for r in few.orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert collision_search.nearest_neighbours(df.where("false")).count() == 0


# --- 6: sharding ----------------------------------------------------------------------------------


def test_shards_are_exact(spark, docs, monkeypatch):
    monkeypatch.setattr(hypergeometric_sharding, "LEAST_CELLS", 3)
    monkeypatch.setattr(hypergeometric_sharding, "LEAST_BUCKETS", 4)
    clashing = documents(spark, extra=True)
    for name in ("bucket", "place", "ends", "cell", "nth", "first"):
        clashing = clashing.withColumn(name, F.lit("own"))
    sharded = hypergeometric_sharding.shard_documents(clashing, shards=5)
    assert sorted(sharded.columns) == sorted(clashing.columns)
    found = sharded.collect()
    again = hypergeometric_sharding.shard_documents(clashing, shards=5).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    shards: dict = {}
    for r in found:
        shards.setdefault(r["shard"], []).append(r["slot"])
    n = docs.count()
    assert sorted(len(s) for s in shards.values()) == sorted(n // 5 + (i < n % 5) for i in range(5))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    whole = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in found) == whole
    assert hypergeometric_sharding.shard_documents(docs.where("false")).count() == 0


def test_shuffle_is_uniform(spark):
    """Places are independent of the order of rows: by shard, along each shard and for neighbours."""
    n, shards = 6000, 4
    rows = spark.range(n).coalesce(1).cache()
    for seed in (20, 77):
        found = sorted((r["shard"], r["slot"], r["id"]) for r in hypergeometric_sharding.shuffle_into_shards(rows, F.col("id"), shards, seed).collect())
        ids = np.array([i for _, _, i in found]).reshape(shards, -1)
        sd = np.sqrt(n / shards * 0.25 * (1 - 1 / shards))  # of the smaller half of ids in a shard
        assert (np.abs((ids < n // 2).sum(axis=1) - n / shards / 2) < 4.5 * sd).all()
        flat = ids.ravel()
        for a, b in ((flat[:-1], flat[1:]), *[(np.arange(ids.shape[1]), line) for line in ids]):
            assert abs(np.corrcoef(a, b)[0, 1]) < 4.5 / np.sqrt(len(a))


def test_hypergeometric_law():
    import random

    rng = random.Random(1)
    draws = [hypergeometric_sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert np.mean(draws) == pytest.approx(6, abs=0.05) and np.var(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.05)
    matrix = hypergeometric_sharding.communication_matrix([5, 0, 9, 3], [6, 6, 5], 1)
    assert [sum(r) for r in matrix] == [5, 0, 9, 3] and [sum(c) for c in zip(*matrix, strict=True)] == [6, 6, 5]
    assert hypergeometric_sharding.hypergeometric(rng, 10**9, 10**9, 10**6) == pytest.approx(5 * 10**5, rel=0.01)


# --- 7: quality rules ---------------------------------------------------------------------------------


def plain_counts(text) -> tuple:
    text = text or ""
    found = words(text)
    windows: dict = {}
    for s in range(len(found) - 7):
        windows.setdefault(tuple(found[s : s + 8]), []).append(s)
    covered = {i for starts in windows.values() if len(starts) > 1 for s in starts for i in range(s, s + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, labels):
    found = risk_thresholds.quality_verdicts(docs, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = sorted((str(r["doc_id"]), *plain_counts(r["text"])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in found) == expected
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert risk_thresholds.quality_verdicts(docs.where("false"), labels).count() == 0
    assert risk_thresholds.quality_verdicts(docs, labels.where("false")).where("not base_failed and not kept").count() == 0


def test_binomial_tail_is_exact(spark):
    import math

    cases = [(0, 50, 0.02), (3, 400, 0.02), (0, 1, 0.5), (25, 3000, 0.02), (6000, 400_000, 0.02)]
    for k, n, p in cases:
        found = spark.range(1).select(risk_thresholds.log_binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        top = max(logs)
        assert found == pytest.approx(top + math.log(sum(math.exp(x - top) for x in logs)), abs=1e-6)


def test_cutoffs_reject_junk_and_spare_good(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(30)), "en") for i in range(900)]  # enough for a bound of one percent
    junk = [(1000 + i, " ".join(f"w{i}x{j}###" for j in range(30)), "en") for i in range(50)]
    docs = spark.createDataFrame(good + junk + [(5000, junk[0][1], "xx")], "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(d[0], 1) for d in good] + [(d[0], 0) for d in junk], "doc_id long, quality int")
    kept = {r["doc_id"] for r in risk_thresholds.kept_documents(docs, labels).collect()}
    assert kept == {d[0] for d in good} | {5000}  # no rule is on in a stratum without labels


# --- 8: mixing --------------------------------------------------------------------------------------------


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped: set = set()
    total = sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        more = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not more:
            return target
        capped |= more


def test_targets_and_copies(spark):
    rng = np.random.default_rng(4)
    sizes = {"a": 5000, "b": 30, "C": 800, "é": 10, None: 300, "z": 0, "d": 2500}
    rows, i = [], 0
    for s, total in sizes.items():
        left = total
        while left > 0 or total == 0:
            n = int(min(left, rng.integers(0, 40)))
            rows.append((i, " ".join(["w"] * n), s))
            i, left = i + 1, left - n
            if total == 0:
                break
    rows += [rows[0], (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = systematic_mixing.mixture(docs).collect()
    assert len(found) == len(rows)
    real: dict = {}
    for _, t, s in rows:
        real[s] = real.get(s, 0) + len(words(t))
    expected = plain_targets(real)
    by_size = {(v, expected[s]) for s, v in real.items()}
    assert all(any(v == r["source_size"] and t == pytest.approx(r["target"]) for v, t in by_size) for r in found)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    for v, t in by_size:
        taken = sum(r["taken"] for r in found if r["source_size"] == v and r["target"] == pytest.approx(t))
        assert abs(taken - t) <= 60
    assert sorted(map(repr, found)) == sorted(map(repr, systematic_mixing.mixture(docs.withColumn("class", F.lit("own")).withColumn("size", F.lit("own"))).collect()))
    assert systematic_mixing.mixture(docs.where("false")).count() == 0


def test_mixed_documents_keep_columns(spark):
    docs = documents(spark, extra=True)
    out = systematic_mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    sizes: dict = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    taken: dict = {}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    longest = max(len(words(r["text"])) for r in docs.collect())
    for source, target in plain_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 3 * longest
    whole = {(r["doc_id"], r["text"], r["source"], r["size"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"], r["source"], r["size"]) for r in out.collect()} <= whole
    assert max(r["count"] for r in out.where("doc_id > 6").groupBy("doc_id").count().collect()) <= 3


# --- 10: classifier ---------------------------------------------------------------------------------------------


def test_classifier_learns_and_scores_everything(spark, docs):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    good = [(i, " ".join(word() for _ in range(60))) for i in range(200)]
    bad = [(1000 + i, " ".join(word() + "###" for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame([*good, *bad, (5000, None), (5001, ""), (None, good[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    found = byte_cnn.quality_scores(df, labels).collect()
    assert len(found) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 2000]
    assert np.mean([r["predicted"] == (r["doc_id"] < 1000) for r in held]) > 0.95
    assert {r["score"] for r in byte_cnn.quality_scores(df, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in byte_cnn.quality_scores(df, labels.where("false")).collect()} == {0.5}
    clashing = byte_cnn.quality_scores(documents(spark, extra=True).withColumn("score", F.lit("own")).withColumn("quality", F.lit(0)), labels)
    assert clashing.columns == ["doc_id", "held_out", "score", "predicted"] and clashing.count() == docs.count()
    assert byte_cnn.quality_scores(df.where("false"), labels).count() == 0


def test_whole_words_are_compared():
    texts = [b"internationalizations1 internationalizations2 x y", b"a a  a\n\nb b", b"", b" ", b"x", b"ab ab", "é é è".encode(), b"aa a aa a a", b"z" * 300 + b" " + b"z" * 300]
    for text in texts:
        expected, before = np.zeros(len(text), bool), None
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", text):
            expected[m.start() : m.end()] = m[0] == before
            before = m[0]
        assert (byte_cnn.repeats(text) == expected).all() and (byte_cnn.repeats_of(text) == expected).all()


def test_repeats_of_long_texts(monkeypatch):
    rng = np.random.default_rng(10)
    text = b" ".join(rng.choice([b"a", b"bb", b"a" * 40], 500))
    whole = byte_cnn.repeats(text)
    monkeypatch.setattr(byte_cnn, "pieces_of", lambda t: _shared.pieces_of(t, 17))
    assert (byte_cnn.repeats_of(text) == whole).all() and whole.any()


def test_score_is_that_of_a_plain_forward_pass():
    network, rng = byte_cnn.Network(), np.random.default_rng(12)
    network.w = {k: rng.normal(0, 0.4, v.shape).astype(np.float32) for k, v in network.w.items()}
    for text in (b"", b"hello", b"one one two three " * 60, bytes(rng.integers(9, 127, 1111).astype(np.uint8))):
        data = text + bytes(max(1, -(-(len(text) + 4) // 256)) * 256 - len(text))
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        again = {i for (_, _, a), (s, e, b) in zip(words, words[1:], strict=False) if a == b for i in range(s, e)}
        row = lambda i: [*network.w["embed"][data[i]].tolist(), float(i in again)]
        unit = lambda u: np.array([x for i in range(4 * u, 4 * u + 4) for x in row(i)])
        n = len(data) // 4
        z = []
        for u in range(n):
            z.append(unit(u) @ network.w["first"] + network.w["bias"] + (unit(u + 1) @ network.w["second"] if u + 1 < n else 0))
        chunks = [np.maximum(np.max(z[a : min(a + 128, n)], axis=0), 0) for a in range(0, max(n - 64, 1), 64)]  # 512 bytes, every 256
        logit = np.max(chunks, axis=0) @ network.w["out"] + network.w["shift"][0]
        assert network.score(text) == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_long_texts_are_scored_whole():
    network = byte_cnn.Network()
    rng = np.random.default_rng(7)
    text = bytes(rng.integers(32, 127, byte_cnn.PIECE * 2 + 777).astype(np.uint8))
    data, extra = byte_cnn.marks(text)
    z = network.responses(network.units(data, extra), np.zeros(1, np.int64)).reshape(-1, byte_cnn.HALF // byte_cnn.UNIT, byte_cnn.FILTERS)
    assert np.allclose(network.half_peaks(text), np.maximum(z.max(axis=1), 0), atol=1e-4)


def test_gradients_by_differences():
    rng = np.random.default_rng(8)
    network = byte_cnn.Network()
    network.w = {k: rng.normal(0, 0.3, v.shape).astype(np.float64) for k, v in network.w.items()}
    batch = [byte_cnn.marks(bytes(rng.integers(97, 103, n).astype(np.uint8))) for n in (10, 600, 300)]
    goal = np.array([1.0, 0.0, 1.0])

    def loss() -> float:
        total = 0.0
        for (data, extra), y in zip(batch, goal, strict=True):
            z = network.responses(network.units(data, extra), np.zeros(1, np.int64)).reshape(-1, byte_cnn.HALF // byte_cnn.UNIT, byte_cnn.FILTERS)
            halves = np.maximum(z.max(axis=1), 0)
            chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
            logit = chunks.max(axis=0) @ network.w["out"] + network.w["shift"][0]
            total += np.log1p(np.exp(-logit if y else logit))
        return total / len(batch)

    found = network.gradients(batch, goal)
    for name in ("first", "second", "bias", "out", "shift", "embed"):
        flat, grad = network.w[name].reshape(-1), np.asarray(found[name], float).reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / 2e-3, rel=0.1, abs=2e-3)
