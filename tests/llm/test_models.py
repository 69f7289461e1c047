import math
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import edge_rows, prose, table, words

from slotwise.llm import language, lm, quality


def _mod(i, m):
    return zlib.crc32(str(i).encode()) % m


def _level(n):
    return 1 + int(math.log2(n)) if n else 0


def test_lm_counts_are_exact_and_scores_follow_the_filter(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 20_000)
    rows = [(i, t) for i, t in edge_rows() if i != 20]
    got = {r.doc_id: r for r in lm.language_model_scores(table(spark, rows)).collect()}
    tokens = {i: [*words(t), None] for i, t in rows}
    single, pair = Counter(), Counter()
    for i, w in tokens.items():
        if i is not None and _mod(i, 7) != 2:
            single.update(w)
            pair.update(zip([None, *w], w))
    total, types = sum(single.values()), len(single)
    p = {w: math.log10((single[w] + 1) / (total + types + 1)) for ws in tokens.values() for w in ws}
    off = 0
    for i, w in tokens.items():
        r = got[i]
        assert r.held_out == (i is None or _mod(i, 7) == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(single[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(p[x] for x in w))
        score = 0.0
        for before, x in zip([None, *w], w):
            count = min(float(lm.count_at(np.array([_level(pair[before, x])]))[0]), single[before], single[x])
            score += math.log10((count + lm.MU * 10 ** p[x]) / (single[before] + lm.MU))
        assert r.score >= score - 1e-9  # a filter errs upwards only
        off += abs(r.score - score) > 1e-9
    assert off <= len(rows) // 4


def test_lm_without_rows_and_without_training_rows(spark):
    assert lm.language_model_scores(table(spark, [])).collect() == []
    only = next(i for i in range(100) if _mod(i, 7) == 2)
    row = lm.language_model_scores(table(spark, [(only, "a b")])).head()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_filter_never_loses_a_level():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    counts = rng.integers(1, 200, len(pairs))
    parts = 3
    data, starts, sizes = [], [], []
    part = (pairs >> np.uint64(32)) % np.uint64(parts)
    for k in range(parts):
        bits = lm.section(pairs[part == k].astype(np.uint32), counts[part == k])
        starts.append(sum(map(len, data)))
        sizes.append(8 * len(bits))
        data.append(bits)
    held = lm.CountFilter(np.concatenate(data), np.array(starts), np.array(sizes, np.uint64))
    levels = held.levels(pairs)
    assert (levels >= lm.level_of(counts)).all() and (levels == lm.level_of(counts)).mean() > 0.98
    other = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    assert (held.levels(other) > 0).mean() < 0.03


def _phrases(text, reference):
    """Greedy longest matches, letter by letter."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in reference:
            end += 1
        count += 1
        at = end
    return count


def test_phrases_are_those_of_greedy_longest_matches():
    reference = {"a": "the cat sat on the mat and the hat", "b": "der hund und das haus und der hut"}
    model = language.build({k: [v] for k, v in reference.items()})
    texts = ["the hat and the cat", "das haus", "zebra the", "und the und the", "q", "12", "", None, "the " * 400]
    size, count = language.phrases(texts, model)
    for text, n, row in zip(texts, size, count):
        plain = (text or "").lower().lstrip()
        if not any(c.isalpha() for c in plain):
            assert n == 0
            continue
        expected = []
        for k in ("a", "b"):
            lanes = [plain[i : i + language.LANE] for i in range(0, len(plain), language.LANE)]
            expected.append(sum(_phrases(x, reference[k] + " ") for x in lanes))
        assert n == len(plain)
        # The last phrase of a lane counts as one whether or not a letter opened it.
        assert all(abs(int(g) - e) <= len(lanes) for g, e in zip(row, expected))


def test_language_is_learned_and_odd_rows_are_defined(spark):
    other = str.maketrans("aeioukmtrnslpvdq", "øæåyüzghwbcfxjßç")
    rows = [(i, prose(i, 80) if i % 2 else prose(i, 80).translate(other), "xx" if i % 2 else "yy") for i in range(60)]
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "123 !", "xx"), (None, prose(3, 30), None), (503, prose(9, 20), None)]
    rows += [(504, prose(5, 30_000), "xx"), (504, prose(5, 30_000), "xx")]
    df = table(spark, rows, "doc_id long, text string, lang string")
    got = language.identified(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i in range(60):
        assert by_id[i].lang_pred == ("xx" if i % 2 else "yy")
        assert by_id[i].held_out == (_mod(i, 4) == 2)
    assert all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert [by_id[i].lang_pred for i in (None, 503, 504)] == ["xx"] * 3
    nothing = table(spark, [(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identified(nothing).collect()] == [("und", 0.0)]
    assert language.identified(table(spark, [], "doc_id long, text string, lang string")).collect() == []


def test_gradients_are_those_of_the_loss():
    texts, labels = ["abc def " * 90, "", "zz ## zz ## " * 9], np.array([1, 0, 0], np.float32)
    net = quality.Network(*[a.astype(np.float64) for a in quality.Network.start().arrays()])

    def loss():
        p = quality.scores(net, texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    got = quality._gradients(net, texts, labels)
    rng = np.random.default_rng(0)
    for array, gradient in zip(net.arrays(), got):
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in array.shape)
            kept = array[at]
            array[at] = kept + 1e-3
            up = loss()
            array[at] = kept - 1e-3
            down = loss()
            array[at] = kept
            assert gradient[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_a_text_scores_the_same_next_to_any_other():
    net = quality.Network.start()
    texts = ["abc " * n for n in (0, 1, 15, 16, 17, 126, 127, 128, 500)] + [None, "x$$$ " * 300]
    alone = [quality.scores(net, [t])[0] for t in texts]
    assert quality.scores(net, texts) == pytest.approx(alone, rel=1e-5)
    assert quality.scores(net, texts[::-1]) == pytest.approx(alone[::-1], rel=1e-5)


def test_quality_is_learned_from_rows_not_held_out(spark):
    rows, labels = [], []
    for i in range(120):
        poor = i % 4 == 0
        rows.append((i, " ".join(w + ("$$$" if poor else "") for w in prose(i, 40).split())))
        labels.append((i, int(not poor)))
    rows += [(500, None), (501, ""), (502, prose(7, 30_000)), (None, "x"), (0, rows[0][1])]
    labels += [(None, 1), (3, 1), (9, None)]
    known = table(spark, labels, "doc_id long, quality int")
    got = quality.classified(table(spark, rows), known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 120 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(120) if _mod(i, 5) == 0}
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) >= 0.95
    none = quality.classified(table(spark, [(1, "a"), (2, None)]), known.limit(0)).collect()
    assert [r.score for r in none] == [0.5, 0.5]
    assert quality.classified(table(spark, []), known).collect() == []
