"""Language of whole texts by cross-parsing against suffix automata of labelled text.

Letters of labelled sample texts of a language form a reference; its suffix automaton
tells, letter by letter, how far a match with some place in the reference goes on.  A
text is parsed greedily into longest matches; the language that needs the fewest
phrases per letter wins.  Upper case is lowered, and every run of other characters is
one gap, so symbols and numbers neither help nor hurt.

The automata of all languages lie in one table of next states; a step moves every lane
(a stretch of ``LANE`` letters of some text, in some language) with a few numpy calls.
All of a text is parsed: long texts take more lanes, each parsed from a fresh phrase.

Bounds: a reference comes from at most ``sample_docs`` documents per language, those of
least hash among documents of at most ``sample_chars`` characters (if there are too few,
the shortest others; never one of more than a million characters), and the table tells
``LETTERS`` letters apart; rarer ones count as one letter.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0,
as is every text if nothing could be learned; equal counts go to the language first in
alphabetical order; repeated rows are rows of their own; further columns are not read.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.store import in_small_batches

LANE = 512
LANES_AT_ONCE = 4096
LETTERS = 90
SAMPLE_MOST_CHARS = 1_000_000
UNKNOWN = "und"
_FLAG = 29  # phrases ended by a step are kept above this bit
_GAP, _OTHER, _PAD = 0, 1, 2


@dataclass
class LanguageModel:
    languages: list[str]
    classes: np.ndarray  # of every code point: gap, other letter, or a letter of its own
    steps: np.ndarray  # flat table of next states
    roots: np.ndarray  # first state of each language, as an offset into the table


def suffix_automaton(letters: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the root."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for letter in letters:
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and letter not in following[at]:
            following[at][letter] = state
            at = link[at]
        if at >= 0:
            target = following[at][letter]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                link[target] = link[state] = copy
                while at >= 0 and following[at].get(letter) == target:
                    following[at][letter] = copy
                    at = link[at]
        last = state
    return following


def _letter_flags() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _coded(text: str | None, classes: np.ndarray) -> np.ndarray:
    """Letter classes of a text, gaps joined; empty without a letter."""
    code = classes[_code_points(text)] if text else np.zeros(0, np.uint8)
    gap = code == _GAP
    code = code[~(gap & np.concatenate([[True], gap[:-1]]))] if len(code) else code
    return code if (code != _GAP).any() else code[:0]


def build(samples: dict[str, list[str]]) -> LanguageModel:
    """The model of labelled texts."""
    seen: Counter[int] = Counter()
    flags = _letter_flags()
    for texts in samples.values():
        for text in texts:
            points, n = np.unique(_code_points(text), return_counts=True)
            seen.update({int(p): int(c) for p, c in zip(points, n) if flags[p]})
    classes = np.where(flags, _OTHER, _GAP).astype(np.uint8)
    own = sorted(seen, key=lambda p: (-seen[p], p))[:LETTERS]
    for i, point in enumerate(own):
        classes[point] = _PAD + 1 + i
    width = _PAD + 1 + len(own)
    languages, tables, roots, states = [], [], [], 0
    for language in sorted(samples):
        letters = np.concatenate([np.zeros(0, np.uint8), *[np.append(_coded(t, classes), _GAP) for t in samples[language]]])
        if not (letters != _GAP).any():
            continue
        following = suffix_automaton(letters.tolist())
        table = np.full((len(following), width), -1, np.int64)
        for state, to in enumerate(following):
            table[state, list(to)] = list(to.values())
        missing = table < 0
        restart = np.where(table[0] < 0, 0, table[0])
        ended = np.where(missing[0], 2, 1) * np.ones((len(following), 1), np.int64)
        ended[0] = 1  # at the root no phrase is open: an unknown letter is a phrase of its own
        steps = (np.where(missing, restart, table) + states) * width
        steps |= np.where(missing, ended, 0) << _FLAG
        steps[:, _PAD] = (np.arange(len(following)) + states) * width
        languages.append(language)
        roots.append(states * width)
        states += len(following)
        tables.append(steps.astype(np.int32))
    if states * width >= 1 << _FLAG:
        raise ValueError("the references are too long for the table; lower sample_docs or sample_chars")
    flat = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
    return LanguageModel(languages, classes, flat, np.array(roots, np.int32))


def fit(docs: DataFrame, sample_docs: int = 16, sample_chars: int = 4000) -> LanguageModel:
    """The model of the labelled rows (text, lang), from a bounded sample of each language."""
    chars = F.length("text")
    order = Window.partitionBy("lang").orderBy(F.greatest(chars - sample_chars, F.lit(0)), F.xxhash64("text"))
    rows = (
        docs.filter(F.col("lang").isNotNull() & chars.between(1, SAMPLE_MOST_CHARS))
        .select("text", "lang", F.row_number().over(order).alias("nth"))
        .filter(F.col("nth") <= sample_docs)
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.nth)):
        samples.setdefault(row.lang, []).append(row.text)
    return build(samples)


def phrases(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Letters (with gaps) of each text, and its phrases in each language."""
    coded = [_coded(t, model.classes) for t in texts]
    size = np.array([len(c) for c in coded], np.int64)
    lanes = -(-size // LANE)
    count = np.zeros((len(texts), len(model.languages)), np.int64)
    owner = np.repeat(np.arange(len(texts)), lanes)
    if not len(owner) or not len(model.languages):
        return size, count
    cells = np.full((len(owner), LANE), _PAD, np.uint8)
    first = np.concatenate([[0], np.cumsum(lanes)])
    for i, code in enumerate(coded):
        cells[first[i] : first[i + 1]].ravel()[: len(code)] = code
    used = np.minimum(size[owner] - (np.arange(len(owner)) - first[owner]) * LANE, LANE)
    order = np.argsort(-used, kind="stable")  # lanes of like length together
    for at in range(0, len(order), LANES_AT_ONCE):
        lane = order[at : at + LANES_AT_ONCE]
        columns = np.ascontiguousarray(cells[lane].T)
        state = np.repeat(model.roots[:, None], len(lane), axis=1)
        ended = np.ones(state.shape, np.int32)
        for column in columns[: used[lane[0]]]:
            moved = model.steps[state + column]
            ended += moved >> _FLAG
            state = moved & ((1 << _FLAG) - 1)
        np.add.at(count, owner[lane], ended.T)
    return size, count


def predict(docs: DataFrame, model: LanguageModel, carried: Sequence[str] = ()) -> DataFrame:
    """``docs`` (doc_id, text, held_out) with lang_pred, score, letters per phrase and the carried columns.

    The score is how much fewer phrases the best language needs than the next one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores, length = [], [], []
            for run_of in _runs(texts):
                size, count = phrases(run_of, held)
                for n, row in zip(size.tolist(), count):
                    if not n or not len(row):
                        names.append(UNKNOWN), scores.append(0.0), length.append(0.0)
                        continue
                    best = int(row.argmin())
                    rest = np.delete(row, best).min() if len(row) > 1 else n
                    names.append(held.languages[best])
                    scores.append(max(0.0, 1 - int(row[best]) / max(1, int(rest))))
                    length.append(n / int(row[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(length, pa.float64()), *map(batch.column, carried)],
                names=["doc_id", "held_out", "lang_pred", "score", "letters_per_phrase", *carried],
            )

    given = docs.select("doc_id", "held_out", "text", *carried)
    schema = T.StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double, letters_per_phrase double")
    return given.mapInArrow(run, T.StructType([*schema, *(given.schema[c] for c in carried)]))


def _runs(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carried: Sequence[str] = ()
) -> DataFrame:
    """Language of every row, learned from rows whose crc32(id as text) mod 4 is not 2; carried columns stay beside it."""
    rows = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), *carried
    )
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True)))
    return predict(rows, fit(rows.filter(~F.col("held_out"))), carried)
