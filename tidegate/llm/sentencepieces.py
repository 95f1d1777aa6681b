"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked as the model does it (a mark before it, a mark for each space) and splits into marked words:
no piece holds a mark behind another character, so no piece crosses from one word into the next.
The distinct words of a chunk are sorted, which lays them out as the depth-first walk of their trie:
going from a word to the next one, the forward states of their common prefix stay and only the
branch below it is computed. A word then reads its segmentation back from its states.

The forward state of a prefix is the best score of its segmentations, and the start of the last piece of the best one. The score
of a segmentation is the sum of its pieces' scores and of its transitions':
* in a unigram model every transition is worth 0 (Viterbi as it stands);
* in a BPE model the transition from piece s to piece t is worth 0 where BPE of s + t is s and t, and minus infinity otherwise. A
  segmentation whose transitions are all allowed is the model's own, so the best score is that of the model's ids. Piece scores alone, which are merge
  ranks and not log probabilities, would give other ids. As one piece alone may end a prefix, the search for it stops at the first.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tidegate.llm.common import TEXTS, batched, table, trimming

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of text that are segmented together, and words that are remembered from chunk to chunk, and from task to task.
CHUNK_CHARS, MEMORY, KEPT = 2_000_000, 400_000, 100_000
TAIL = 3
UNITS = re.compile(rf"{MARK}*[^{MARK}\n\t]+|{MARK}+|[\n\t]")


class Pieces:
    """Vocabulary of a model, and the encodings of words met so far."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {text[i]: i for i in range(n) if not special[i]}
        self.score = {text[i]: sp.get_score(i) for i in range(n) if not special[i]}
        self.longest = max(map(len, self.ids))
        # lengths of the pieces that end in given characters, longest first: only these need a look
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            tails.setdefault(p[-TAIL:], set()).add(len(p))
        short = range(TAIL - 1, 0, -1)
        self.tails = {t: (*sorted((x for x in n if x >= TAIL), reverse=True), *short) for t, n in tails.items()}
        self.short = tuple(short)
        if any(MARK in p.lstrip(MARK) or re.search("[\n\t]", p) and len(p) > 1 for p in self.ids):
            raise ValueError("a piece holds a mark or a line break behind another character; words can't be cut at marks")
        self.bpe = all(s <= 0 and s == int(s) for s in self.score.values())
        self.penalty = min(self.score.values()) - 10
        self.shown = [b"" if sp.is_control(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.likely: dict[str, str] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, word: str) -> list[str]:
        """BPE of a short string from the definition: merge the pair of best score, leftmost first."""
        parts = list(word)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, last: str, piece: str) -> bool:
        key = (last, piece)
        if (ok := self.pairs.get(key)) is None:
            ok = self.pairs[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return ok

    def extend(self, word: str, starts: list[int], lasts: list[str], scores: list[float]) -> None:
        """Append the states of the prefixes of ``word`` that are missing: start of the last piece, the piece, score.

        A character without a piece stands alone, for a penalty.
        """
        value_of, pairs, tails, short, likely, bpe = self.score, self.pairs, self.tails, self.short, self.likely, self.bpe
        for end in range(len(starts), len(word) + 1):
            if bpe:
                # only one transition is allowed, so any that is will do: first the one that followed such a prefix last time
                key = lasts[end - 1] + word[end - 1]
                piece = likely.get(key)
                if piece is not None:
                    at = end - len(piece)
                    if at >= 0 and pairs.get((lasts[at], piece)) and (len(piece) <= len(key) or word[at:end] == piece):
                        starts.append(at)
                        lasts.append(piece)
                        scores.append(scores[at] + value_of[piece])
                        continue
            at, best = end - 1, None
            for size in tails.get(word[end - TAIL : end], short) if end >= TAIL else range(end, 0, -1):
                start = end - size
                if start < 0:
                    continue
                piece = word[start:end]
                if piece not in value_of:
                    continue
                if bpe:
                    if pairs.get((lasts[start], piece)) or self.follows(lasts[start], piece):
                        at, best = start, scores[start] + value_of[piece]
                        likely[key] = piece
                        break
                elif best is None or scores[start] + value_of[piece] > best:
                    at, best = start, scores[start] + value_of[piece]
            starts.append(at)
            lasts.append(word[at:end])
            scores.append(scores[at] + self.penalty if best is None else best)

    def learn(self, words: set[str]) -> None:
        """Encodings of new words: one depth-first walk over the trie of the sorted words."""
        if len(self.known) > MEMORY:
            self.forget()
        before, starts, lasts, scores, ids = "", [0], [""], [0.0], self.ids
        for word in sorted(words - self.known.keys()):
            common, most = 0, min(len(before), len(word))
            while common < most and before[common] == word[common]:
                common += 1
            del starts[common + 1 :], lasts[common + 1 :], scores[common + 1 :]
            self.extend(word, starts, lasts, scores)
            out: list[int] = []
            end = len(word)
            while end:
                piece = lasts[end]
                if piece in ids:
                    out.append(ids[piece])
                elif self.bytes_at:
                    out += [self.bytes_at[b] for b in reversed(piece.encode("utf-8", "replace"))]
                else:
                    out.append(self.unknown)
                end = starts[end]
            self.known[word] = array("i", out[::-1]).tobytes()
            before = word
            if len(self.pairs) > MEMORY // 2:
                self.pairs.clear()
                self.likely.clear()

    def forget(self, kept: int = KEPT) -> None:
        """Keep the words and pairs that were met first, which are mostly the frequent ones."""
        for name in ("known", "pairs", "likely"):
            setattr(self, name, dict(islice(getattr(self, name).items(), kept)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*units))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, u)), np.int32) for u in units]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces as bytes, marks as spaces, the first mark dropped."""
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_made: dict[bytes, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """One per Python worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _made:
        _made[key] = Pieces(model)
    return _made[key]


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids (array<int>), decoded_sha256, round_trip.

    ``ids`` are the model's for the whole text; ``decoded_sha256`` is of the text decoded from them
    (UTF-8), and round_trip whether that is the text with its marks read as spaces (the model writes both
    alike). A null or empty text has no ids and round-trips. Equal rows give equal rows; an empty table gives none.
    The driver reads the model file (a fixed size) and ships its bytes with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            at = 0
            for texts in chunks([t or "" for t in batch.column(1).to_pylist()]):
                ids = own.encode(texts)
                back = [own.decode(x) for x in ids]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if len(ids) else np.zeros(0, np.int32))),
                        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back]),
                        pa.array([t == s.replace(MARK, " ") for t, s in zip(back, texts, strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
                )
                at += len(texts)
        own.forget()

    return batched(docs).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(trimming(run, TEXTS), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids decode to the empty text."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return batched(encoded).selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "ids").mapInArrow(trimming(run, TEXTS), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every kept document."""
    return encode(docs)
