"""Token counts of whole texts under a unigram tokenizer, without making the tokens.

The vocabulary and its scores come from a public tokenizer file. Spaces become the mark U+2581, and
one is put before a text that does not start with it. A text is cut into words, each a run of marks
and what follows up to the next mark, if no piece of the vocabulary holds a mark behind another
character, so that no piece crosses words, and all scores are whole numbers, so that their sums are
exact wherever they start. Then the counts of the words' best segmentations add up to that of the
text. With any other vocabulary a text is one word, as the rounding of sums from its start decides
between candidates.

An Aho-Corasick automaton enumerates the vocabulary matches of a word; dynamic programming over
their ends carries the best score and its number of pieces, not the pieces. Ties go to the
candidate that starts first, as in the tokenizer's own search, whose order they follow. A character
without a piece of its own costs the lowest score less ten and counts its UTF-8 bytes (byte
fallback). Scores are summed from the left as 64-bit floats.

Counts of words are kept in a bounded table per worker. Defined results: a null or empty text has
no tokens; repeated rows count each; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.blocks import blocks, kept

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1_000_000
LONGEST_CACHED = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Number of tokens of a word with its marks, computed when first asked for."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        crossing = any(MARK in piece.lstrip(MARK) for piece, _ in pieces)
        whole = all(float(score).is_integer() for _, score in pieces)
        self.words = re.compile(f"{MARK}+[^{MARK}]*" if whole and not crossing else "(?s).+")

    def __missing__(self, word: str) -> int:
        found = self.best(word)[1]
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation."""
        matches = self.automaton.iter(text)
        at, found = next(matches, (len(text), None))
        scores, counts = [0.0], [0]
        for end, character in enumerate(text):
            best = None
            single = False
            # Matches of one end come longest first, so the first of equals starts first.
            while at == end:
                length, score = found
                total = scores[end + 1 - length] + score
                if best is None or total > best:
                    best, count = total, counts[end + 1 - length] + 1
                single = single or length == 1
                at, found = next(matches, (len(text), None))
            if not single:
                total = scores[end] + self.unknown
                if best is None or total > best:
                    best = total
                    count = counts[end] + len(character.encode("utf-8", "surrogatepass"))
            scores.append(best)
            counts.append(count)
        return scores[-1], counts[-1]

    def count(self, text: str) -> tuple[int, int]:
        """Numbers of words and tokens of a text."""
        if not text:
            return 0, 0
        marked = text.replace(" ", MARK)
        words = self.words.findall(marked if marked.startswith(MARK) else MARK + marked)
        return len(words), sum(map(self.__getitem__, words))


def counter(path: str) -> Counter:
    """This worker's counter for a vocabulary file."""
    return kept(f"counter {path}", lambda: Counter(vocabulary(path)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_words, n_tokens``, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            for rows, _ in blocks(batch):
                pairs = [count(t or "") for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(pa.array(c, pa.int64()) for c in zip(*pairs))],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    ).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
