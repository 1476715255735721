"""Operator 8, token counts: the number of pieces of a unigram model's best segmentation."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.common import held, in_batches, table

#: Words whose counts a worker remembers before it starts afresh.
CACHE_WORDS = 300_000
#: The word mark of the vocabulary files, and the penalty of an unknown character below the least score (fixed values).
MARK, UNKNOWN = "▁", 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in order of id from a sentencepiece model file.

    The public files hold no unigram model, so scores follow Zipf's law in the rank that
    the file gives its pieces: the logarithm of 1 / (rank + 1). Control and byte pieces
    keep their place with the lowest score and never match, except as the file says.
    """
    from math import log

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: -sp.get_score(i)))}
    return [(sp.id_to_piece(i), -log(1.0 + rank.get(i, n))) for i in range(n)]


class Counter:
    """Counts pieces as ``tokenizers`` does with Unigram (unknown id 0, no byte fallback)
    behind Metaspace(prepend_scheme="always", split=True).

    An Aho-Corasick automaton lists the pieces that end at each character, longest
    first, hence by ascending start. The best score to a position and the pieces on its
    path are carried along; a later candidate replaces an earlier one only if it is
    strictly better, so ties go to the longest last piece. A character that no
    one-character piece covers may also be unknown, after the pieces that start there;
    neighbouring unknowns are fused to one piece.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        self.single = set()
        for i, (p, score) in enumerate(pieces):
            if p:
                self.auto.add_word(p, (len(p), score, i == 0))
                if len(p) == 1:
                    self.single.add(p)
        self.auto.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.seen: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Pieces of one stretch without a border of the pre-tokenizer."""
        size = len(w)
        best, count, ends_unknown, set_ = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1), [False] * (size + 1)
        set_[0] = True
        found = self.auto.iter(w)
        nxt = next(found, None)
        for end in range(1, size + 1):
            lone = w[end - 1] not in self.single
            while nxt and nxt[0] == end - 1:
                n, score, is_unknown = nxt[1]
                start = end - n
                x = best[start] + score
                if set_[start] and (not set_[end] or x > best[end]):
                    best[end], set_[end] = x, True
                    count[end] = count[start] + (not (is_unknown and ends_unknown[start]))
                    ends_unknown[end] = is_unknown
                nxt = next(found, None)
            if lone and set_[end - 1]:
                x = best[end - 1] + self.unknown
                if not set_[end] or x > best[end]:
                    best[end], set_[end] = x, True
                    count[end] = count[end - 1] + (not ends_unknown[end - 1])
                    ends_unknown[end] = True
        return count[size]

    def many(self, texts: list[str | None]) -> list[int]:
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            # the pre-tokenizer puts a mark before the text and cuts before each mark
            words = text.replace(MARK, " ").split(" ")
            if text[0] in (" ", MARK):
                words = words[1:]
            try:
                out.append(sum(map(self.seen.__getitem__, words)))
            except KeyError:
                new = set(words).difference(self.seen)
                if len(self.seen) + len(new) > CACHE_WORDS:
                    for w in list(self.seen)[CACHE_WORDS // 2 :]:
                        del self.seen[w]
                    new = set(words).difference(self.seen)
                for w in new:
                    self.seen[w] = self.word(MARK + w)
                out.append(sum(map(self.seen.__getitem__, words)))
        return out


def count(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row; null and empty texts have none.

    Each distinct word of a worker's texts is segmented once while it is remembered. The
    model file is read by each Python worker; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(path, lambda: Counter(vocabulary(path)))
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(counter.many(b.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(in_batches, run, "doc_id long, n_tokens long", path)


def op8(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return count(table(spark, sf_dir, "documents"), "doc_id", "text", path or tokens.vocabulary("piece_bpe_32k.model"))
