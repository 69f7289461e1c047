import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import edge_rows, table

from slotwise.llm import bpe, packing, token_files
from slotwise.llm.store import new_path
from slotwise.llm.vocabulary import Memory, WordIds, load, vocabulary_path

WORDS, BYTES = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")


def _ids(path, texts):
    return [e.ids for e in load(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path, lower", [(WORDS, True), (BYTES, False)])
def test_ids_are_the_librarys(path, lower):
    texts = [t for _, t in edge_rows()]
    assert [list(np.frombuffer(x, "<u4")) for x in WordIds(path, lower).encode(texts)] == _ids(path, texts)


def test_trie_encodes_and_decodes_as_the_library(spark):
    rows = [(i, t) for i, t in edge_rows() if i is not None]
    whole = bpe.encoded(table(spark, rows), WORDS).collect()
    digests = bpe.encoded(table(spark, rows), WORDS, digests=True).collect()
    tokenizer = load(WORDS)
    expected = []
    for (i, _), ids in zip(rows, _ids(WORDS, [t for _, t in rows])):
        expected.append((i, len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in whole) == sorted(expected)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (i, n, sha(a), sha(b)) for i, n, a, b in expected
    )


def test_trie_reads_repeated_letters_like_the_merges():
    merges = bpe.Merges(WORDS)
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + ["hahaha", "nnnnng", "eeeeee"]
    got = {w: [merges.ids[t] for t in tokens] for w, tokens in bpe.encode_words(words, merges)}
    assert got == dict(zip(words, _ids(WORDS, words)))


def test_memory_is_bounded():
    memory = Memory(10)
    for i in range(0, 1000, 5):
        wanted = set(range(i, i + 8))
        for key in memory.missing(wanted):
            memory[key] = key
        assert all(memory[k] == k for k in wanted) and len(memory) + len(memory.old) <= 40


def test_packing_is_whole_gapless_and_tight(spark):
    rows = [(i, t) for i, t in edge_rows() if i is not None and i != 20]
    got = packing.packed_documents(table(spark, rows), WORDS, capacity=512).toPandas()
    expected = []
    for (i, _), ids in zip(rows, _ids(WORDS, [t for _, t in rows])):
        ids = [*ids, 1]
        for piece, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            expected.append((i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    assert sorted(found) == sorted(expected)
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        ends = one["length"].cumsum()
        assert list(one["offset"]) == [0, *ends[:-1]] and ends.iloc[-1] <= 512
    assert got["sequence_id"].nunique() == -(-sum(e[3] for e in expected) // 512)


def test_packing_with_one_length_for_a_third_of_all(spark):
    pieces = spark.range(9000).selectExpr(
        "id as doc_id", "0 as piece", "case when id % 3 = 0 then 700L else 100 + id % 333 end as length"
    )
    got = packing.packed(pieces, 4096).toPandas()
    assert len(got) == 9000
    ordered = got.sort_values(["sequence_id", "offset"])
    for _, one in ordered.groupby("sequence_id"):
        assert list(one["offset"]) == [0, *one["length"].cumsum()[:-1]] and one["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= 1.005 * int(got["length"].sum()) / 4096


def test_packing_of_nothing(spark):
    assert packing.packed_documents(table(spark, []), WORDS).collect() == []


def _fewest(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {room: k for k, room in enumerate(bins) if room >= lengths[i]}.values():
            bins[k] -= lengths[i]
            go(i + 1, bins)
            bins[k] += lengths[i]
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best


def test_dominance_fixes_only_what_some_best_packing_holds():
    rng = np.random.default_rng(3)
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        lengths = [int(x) for x in rng.integers(1, capacity + 1, int(rng.integers(1, 10)))]
        work = packing.Instance(dict(Counter(lengths)), capacity)
        packing.reduce_by_dominance(work)
        rest = [x for x, n in work.left.items() for _ in range(n)]
        assert work.sequences + _fewest(rest, capacity) == _fewest(lengths, capacity)


def test_blocks_hold_any_ids():
    rng = np.random.default_rng(2)
    cases = [
        np.zeros(5), np.array([2**32 - 1]), rng.integers(0, 2**32, 4096), rng.integers(0, 9, 10_000),
        np.where(rng.random(9000) < 0.03, 2**31, rng.integers(0, 500, 9000)), np.zeros(0),
    ]
    for ids in cases:
        ids = ids.astype("<u4")
        payload, starts = token_files.pack(ids)
        assert np.array_equal(token_files.unpack(payload, starts, len(ids)), ids)
        if len(ids) > 5000:
            assert np.array_equal(token_files.unpack(payload, starts, len(ids), 4000, 4300), ids[4000:4300])


def test_token_files_round_trip(spark, monkeypatch):
    rows = [(i, t) for i, t in edge_rows() if i is not None and i != 20]
    expected, at = [], 0
    for (i, _), ids in zip(sorted(rows), _ids(BYTES, [t for _, t in sorted(rows)])):
        ids = [*ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = token_files.round_trip(table(spark, rows), BYTES).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == [e[:4] for e in expected]
    monkeypatch.setattr(token_files, "PAGE", 50)
    folder = new_path(spark, "tokens")
    token_files.write(table(spark, rows), folder, BYTES, False, 2)
    got = token_files.read(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in got) == [(*e[:3], e[4]) for e in expected]


def test_token_files_with_null_and_repeated_ids(spark):
    got = token_files.round_trip(table(spark, [(None, "a"), (3, "b"), (3, "c c")]), BYTES).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (3, 2), (3, 4)]
    assert token_files.round_trip(table(spark, []), BYTES).collect() == []
