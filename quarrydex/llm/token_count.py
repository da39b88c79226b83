"""Operator 2: token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists every piece that occurs in a word; dynamic programming over the
ends carries the best score and the number of pieces of the best path, and nothing else.  Ties follow the
``tokenizers`` library's unigram model: of equal scores the path found first stays, that is the longer last piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import strings

#: What stands before each word, as in the vocabulary.
MARK = "▁"
#: What an unknown character costs below the lowest score.
UNKNOWN = 10.0
#: White space beyond ASCII that separates words too.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Entries of a worker's cache from words to their counts.
CACHE = 1_000_000


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores, the unknown piece first.

    The pieces are those of a public vocabulary in its order; its scores are ranks, so each piece gets the logarithm
    of the probability that Zipf's law gives to its rank.  Control and byte pieces are left out.
    """
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return [("<unk>", 0.0), *((p, -math.log(k + 1) - total) for k, p in enumerate(pieces))]


class Counter:
    """Pieces in the best path of each word."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        for piece, score in pieces[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known: dict[bytes, tuple[int, float]] = {}

    def best(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best path of one word with its mark; unknown characters side by side are one piece."""
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        count, unknown, single = [0] * (n + 1), [False] * (n + 1), [False] * n
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(word):
            ends[end].append(piece)
            if piece[0] == 1:
                single[end] = True
        for end in range(n):
            for size, own in sorted(ends[end], reverse=True):
                s = end + 1 - size
                total = own + score[s]
                if score[end + 1] is None or total > score[end + 1]:
                    score[end + 1], count[end + 1], unknown[end + 1] = total, count[s] + 1, False
            if not single[end]:
                total = self.unknown + score[end]
                if score[end + 1] is None or total > score[end + 1]:
                    score[end + 1], count[end + 1], unknown[end + 1] = total, count[end] + (not unknown[end]), True
        return count[n], score[n]

    def count(self, text: bytes) -> tuple[int, int, float]:
        """Words, tokens and score of a text."""
        parts = text.split()
        known = self.known
        for p in set(parts):
            if p not in known:
                if len(known) >= CACHE:
                    known.clear()
                    return self.count(text) if len(set(parts)) < CACHE else self.slowly(parts)
                known[p] = self.part(p)
        found = [known[p] for p in parts]
        return sum(f[0] for f in found), sum(f[1] for f in found), sum(f[2] for f in found)

    def part(self, part: bytes) -> tuple[int, int, float]:
        words = [w for w in WIDE_SPACE.split(part.decode("utf-8", "replace")) if w]
        found = [self.best(x) for w in words for x in re.split(f"(?!^)(?={MARK})", w if w[0] == MARK else MARK + w)]
        return len(words), sum(f[0] for f in found), sum(f[1] for f in found)

    def slowly(self, parts: list[bytes]) -> tuple[int, int, float]:
        found = [self.part(p) for p in parts]
        return sum(f[0] for f in found), sum(f[1] for f in found), sum(f[2] for f in found)


def count_column(spark, pieces: list[tuple[str, float]]):
    """A column function: text -> struct of n_words, n_tokens, score."""
    shared = spark.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shared.value)
        for batch in batches:
            rows = [counter.count(t) for t in strings(batch)]
            words, tokens, score = (np.array([r[k] for r in rows], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(tokens), pa.array(score)], ["n_words", "n_tokens", "score"])

    return F.arrow_udf(count, "struct<n_words:bigint,n_tokens:bigint,score:double>")


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, score: one row per row of ``docs``.

    Words stand between white space (Unicode's White_Space characters) and start with the mark.  Null, empty and blank texts have
    no words, no tokens and score 0.  A vocabulary without a piece that matches makes one unknown token of each word.
    Rows aren't combined or moved; other columns are ignored.
    """
    count = count_column(docs.sparkSession, vocabulary() if pieces is None else pieces)
    return docs.select("doc_id", count("text").alias("c")).select("doc_id", "c.n_words", "c.n_tokens", "c.score")
