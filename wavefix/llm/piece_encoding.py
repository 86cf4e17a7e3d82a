"""SentencePiece encoding by a table of each prefix's last token, and decoding.

The vocabulary merges the neighbours whose union is the best-scored piece, the leftmost of equals. A
sequence of tokens is the encoding of its text just when every two neighbours are: merging the
two tokens' text alone gives these two back. So each prefix of a text has one last token: of the pieces
that an automaton finds to end there, the one that is compatible with the last token of the prefix before
it. The table is filled left to right, and the ids are read off from its end backwards.

No piece has a word mark after another character, so a text is cut before each run of marks,
and the ids of its parts, which recur, are kept for each process. Texts stream through tasks; nothing is shuffled.

Defined results: a null or empty text is the end id alone and decodes to an empty text; rows that repeat an id
or have none are rows like others; an empty table gives no rows; other columns are ignored. Characters beyond the
vocabulary become byte tokens. A vocabulary with a normaliser's table, with user-defined or unused pieces,
or with pieces across a word's start is refused.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from wavefix.llm.tokens import vocabulary

#: Stands for a blank in pieces.
MARK = "▁"
#: Entries of the memories of parts (about 300 bytes each) and of pairs; once full, new ones are worked out each time.
PARTS, PAIRS = 600_000, 1_000_000
#: Characters of the longest part that is remembered.
LONGEST = 64
_PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PrefixEncoder:
    """``ids(text)`` as the library's own encoder gives them, without an end id."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds = proto.ModelProto.SentencePiece.Type
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only merge vocabularies whose normaliser just marks blanks are known")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not known")
        pieces = [(i, p) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        if any(MARK in p.piece.lstrip(MARK) for _, p in pieces):
            raise ValueError("a piece crosses the start of a word")
        self.score = {p.piece: p.score for _, p in pieces}
        self.id = {p.piece: i for i, p in pieces}
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text, pair by pair."""
        out, score = list(text), self.score
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def compatible(self, last: str, token: str) -> bool:
        """Whether ``token`` can follow ``last`` (empty: can come first)."""
        pair = last, token
        known = self.fits.get(pair)
        if known is None:
            known = self.merged(last + token) == ([last, token] if last else [token])
            if len(self.fits) < PAIRS:
                self.fits[pair] = known
        return known

    def tokens(self, part: str) -> list[str]:
        """Tokens of a text, from the table of its prefixes' last tokens."""
        last = [""] * (len(part) + 1)
        at, found = 0, self.automaton.iter(part)
        fits, compatible = self.fits, self.compatible
        for end, piece in found:  # longest first at each end
            end += 1
            while at < end - 1:  # ends where no piece of the vocabulary fitted: a character of its own
                at += 1
                if not last[at]:
                    last[at] = part[at - 1]
            if not last[end]:
                before = last[end - len(piece)]
                ok = fits.get((before, piece))
                if ok or (ok is None and compatible(before, piece)):
                    last[end] = piece
        for at in range(at + 1, len(part) + 1):
            if not last[at]:
                last[at] = part[at - 1]
        out, at = [], len(part)
        while at:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out

    def _encoded(self, part: str) -> bytes:
        out = array("i")
        for token in self.tokens(part):
            known = self.id.get(token)
            if known is not None:
                out.append(known)
            elif self.byte is not None:
                out.extend(self.byte[b] for b in token.encode("utf-8"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out.tobytes()

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts, out = self.parts, []
        for part in _PART.findall(MARK + text.replace(" ", MARK)):
            known = parts.get(part)
            if known is None:
                known = self._encoded(part)
                if len(part) <= LONGEST and len(parts) < PARTS:
                    parts[part] = known
            out.append(known)
        return np.frombuffer(b"".join(out), np.int32)


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """This process's encoder for a vocabulary file; Python workers keep it between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text), each with the end id last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = encoder(path)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [np.append(use.ids(t), np.int32(use.end)) for t in part["text"]]})

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = encoder(path)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                yield part.assign(text=[use.library.decode(x.tolist()) for x in part["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one step, so that no ids leave a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = encoder(path)
        names = list(map(str, range(use.library.get_piece_size())))
        digest = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                ids = [*use.ids(text).tolist(), use.end]
                rows.append((len(ids), digest(" ".join(map(names.__getitem__, ids))), digest(use.library.decode(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=pdf["doc_id"].array)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(run, "n_tokens long, ids_sha256 string, decoded_sha256 string, doc_id long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_piece_encoding: ids and decoded text of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
