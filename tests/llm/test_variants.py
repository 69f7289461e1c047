import random
import re
import zlib
from collections import Counter

from corpus import prose, table

from slotwise.llm import variants

SCHEMA = "doc_id long, text string"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 199 == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def found(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(r) for r in df.collect())


def misspelt(seed, words, times):
    rng, out = random.Random(seed), []
    for w in words:
        for _ in range(times):
            i, x = rng.randrange(len(w)), rng.choice("aeiouzé\xff")
            out += [rng.choice([w[:i] + x + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + x + w[i:], w])] * rng.choice([1, 5, 6, 30])
    rng.shuffle(out)
    return out


def test_words_forms_and_roots_match_brute_force(spark):
    rng = random.Random(1)
    stems = ["".join(rng.choice("abcdeort") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words = misspelt(2, stems, 12)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    rows += [(50, "GARDEN gÀrden gàrden garden-garden gardens " * 6), (None, "nobody's nobodyy " * 9), (51, None), (52, ""), (53, "123 \t"), (53, "a bb ccc")]
    rows += [(54, "x" * 5000 + " " + "x" * 4999)] * 5 + [(55, "× ÷ aaaa×aaaa aaaa÷aaaa ßßßßßß " * 7), (56, prose(3, 4000))] + [(57, "copied wordsy copies ")] * 30
    rows += [(60 + i, "chainlet " * 6) for i in range(30)] + [(60, "chainled " * 30 + "chaimled " * 6)]
    want = expected(rows)
    assert any(w[3] for w in want) and any(w[5] not in (w[0], w[3]) for w in want)
    assert found(variants.variants(table(spark, rows, SCHEMA))) == want


def test_tiles_lose_no_pair(spark):
    """Anagrams and near words that share their counts, in tiles of a few words."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(500)})
    pairs = {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    df = table(spark, [(w, i) for i, w in enumerate(words)], "word string, n long").select("word", "n")
    for tile in (7, 4096):
        got = [(r.word, r.near, r.near_n) for r in variants.near_words(df, tile).collect()]
        assert len(got) == len(set(got))
        assert {(a, b) for a, b, _ in got} == pairs and all(words[n] == b for _, b, n in got)


def test_every_mistyped_run_is_counted(spark):
    """Enough runs that some hit the fault, at every place and down to too few letters."""
    rows = [(i, " ".join(["letter", "lettering", "Brüssel", "mississippi"][j % 4] for j in range(8))) for i in range(1500)]
    want = expected(rows)
    assert {"brssel", "missisippi"} <= {w[0] for w in want}
    assert found(variants.variants(table(spark, rows, SCHEMA))) == want


def test_long_chains_of_forms(spark):
    chain = [("a" * 30)[:i] + "bcdefgh" for i in range(9)]
    df = table(spark, [(w, f) for w, f in zip(chain, chain[1:])] + [("other", "words")], "word string, form string").select("word", "form")
    assert {(r.word, r.root) for r in variants.roots(df).collect()} == {(w, chain[-1]) for w in chain[:-1]} | {("other", "words")}


def test_tables_without_words(spark):
    assert found(variants.variants(table(spark, [], SCHEMA))) == []
    assert found(variants.variants(table(spark, [(1, None), (2, ""), (3, "short one")], SCHEMA))) == []
