"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick finds the vocabulary's matches, dynamic programming the best path.

The vocabulary is that of a SentencePiece file with its scores, read as a unigram model as the tokenizers library does
(``Unigram`` with byte fallback behind ``Metaspace``): spaces become U+2581, one is put in front of a text that has none there, and text splits
before each. In such a word the automaton yields, for each end, all pieces that end there, longest first. A position keeps the best
score that reaches it and that path's number of pieces, nothing else.

Tie rules, as the library has them: of equal scores the earliest start stays (a later one must be strictly better). A character that no
single-character piece covers may be unknown, at ten below the lowest score; runs of unknown
characters are one unknown, which counts as its UTF-8 bytes (but as one if it is the unknown piece's own string).

Words are independent, so a worker remembers counts of words met before (``REMEMBERED`` bytes in all, a word counting its characters and
``ENTRY`` for what is kept of it, then anew; a longer word is never remembered).

Defined cases: null or empty text has no tokens; texts of any length and unbroken words are linear; null ids and repeated rows pass through; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, texts, tokenizer_file

SPACE, PENALTY, REMEMBERED, ENTRY = "▁", 10.0, 96 << 20, 150


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0) -> None:
        self.automaton = ahocorasick.Automaton()
        for number, (piece, score) in enumerate(pieces):
            self.automaton.add_word(piece, (len(piece), score, self.spelled(piece) if number == unknown_id else 0))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.seen: dict[str, int] = {}
        self.held = 0

    def word(self, word: str) -> int:
        """Number of pieces on the best path. ``closed`` counts those before a run of unknown ones that is still open, ``run`` is that run's bytes,
        ``alone`` is 1 if it is the unknown piece's own string and nothing else, which is one piece."""
        size = len(word)
        best: list[float | None] = [0.0] + [None] * size
        closed, run, alone = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        matches = iter(self.automaton.iter(word))
        pending = next(matches, None)
        for at in range(size):
            top, start, cost, single = None, 0, 0, False
            while pending is not None and pending[0] == at:
                length, score, spelled = pending[1]
                single = single or length == 1
                if (before := best[at + 1 - length]) is not None and (top is None or before + score > top):
                    top, start, cost = before + score, at + 1 - length, spelled
                pending = next(matches, None)
            if not single and (before := best[at]) is not None and (top is None or before + self.unknown > top):
                top, start, cost = before + self.unknown, at, -self.spelled(word[at])
            best[at + 1] = top
            if cost:  # negative for a character, positive for the unknown piece
                closed[at + 1], run[at + 1], alone[at + 1] = closed[start], run[start] + abs(cost), int(cost > 0 and not run[start])
            else:
                closed[at + 1] = closed[start] + (alone[start] or run[start]) + 1
        return closed[size] + (alone[size] or run[size])

    @staticmethod
    def spelled(characters: str) -> int:
        return len(characters.encode("utf-8", "surrogatepass"))

    def words(self, text: str) -> list[str]:
        whole = text.replace(" ", SPACE)
        head, *rest = (whole if whole.startswith(SPACE) else SPACE + whole).split(SPACE)
        return [SPACE + w for w in rest]

    def text(self, text: str) -> int:
        if not text:
            return 0
        total, seen = 0, self.seen
        for word in self.words(text):
            number = seen.get(word)
            if number is None:
                number = self.word(word)
                if len(word) <= REMEMBERED:
                    self.held += len(word) + ENTRY
                    if self.held > REMEMBERED:
                        seen.clear()
                        self.held = len(word) + ENTRY
                    seen[word] = number
            total += number
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(vocabulary(path))
    return _COUNTERS[path]


COUNTED = "doc_id long, n_chars long, n_tokens long"


def counted(docs: DataFrame, name: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """doc_id, code points and tokens of each text."""

    def make():
        own = counter(tokenizer_file(name, folder))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            plain = [t.decode("utf-8", "replace") for t in texts(batch)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in plain], pa.int64()), pa.array([own.text(t) for t in plain], pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, COUNTED)


def op2_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir))
