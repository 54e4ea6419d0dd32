"""Tokenizers cut into chunks that they treat independently, so that a task encodes each distinct chunk once."""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Callable
from functools import cache
from itertools import chain

#: Encoded chunks that a worker keeps, and pieces of chunks: short strings of bytes.
KEPT, PIECES_KEPT = 150_000, 300_000


#: Fixed: Latin letters, ASCII digits and common punctuation, for which Python's classes and the libraries' agree.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[\\t\\n\\r -~{LETTER}¡¿«»–—‘’“”…€]*")
#: Joins plain chunks, so that one pass cuts many; it is a piece of its own.
MARK = "\x02"


class Kept:
    """A bounded cache of what keys map to: twice `most` entries and those of one call. Keys that come up again stay."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that aren't known; the others are in `new`, where the caller puts these."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        out, old = keys.difference(self.new), self.old
        if old and (again := [k for k in out if k in old]):
            self.new.update((k, old[k]) for k in again)
            out.difference_update(again)
        return list(out)


class ChunkCache:
    """Encodings of chunks. `encode` gets the list of distinct chunks that are new and gives a dict."""

    def __init__(self, encode: Callable[[list[str]], dict], most: int = KEPT) -> None:
        self.encode, self.kept = encode, Kept(most)

    def get(self, chunked: list[list[str]]) -> dict:
        """A dict that has all chunks of these texts."""
        if new := self.kept.missing({*chain.from_iterable(chunked)}):
            self.kept.new.update(self.encode(new))
        return self.kept.new


# --- byte-level ranks ---------------------------------------------------------------------------------------------

#: Fixed: the split pattern whose matches never reach across a space after a character that isn't white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space after white space and before white space or the end: there, cutting at spaces would part a run.
_PARTED_RUN = re.compile(r"\s (?!\S)")


def space_chunks(text: str) -> list[str] | None:
    """The text cut before its spaces; None where the tokenizer's pattern could match across such a cut."""
    if _PARTED_RUN.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


# --- sentence pieces ----------------------------------------------------------------------------------------------


@cache
def piece_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return model, not crossing


def piece_chunks(text: str) -> list[str] | None:
    """Words between single spaces: each is encoded as if it were alone, as no piece has a space after another character."""
    if not text or "  " in text or "▁" in text or "\0" in text or text[0] == " " or text[-1] == " ":
        return None
    return text.split(" ")


# --- word-end BPE -------------------------------------------------------------------------------------------------

#: Fixed: how a tokenizer file says that it drops white space, lower-cases, cuts at these pieces and marks word ends.
#: Only such a file's texts are encoded by chunks; for any other, texts go to the library whole.
WORD_END_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pieces": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "suffix": "</w>",
}
#: The word-end vocabularies' pieces of plain chunks that are joined by MARK.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|{MARK}|[^\\s{LETTER}0-9{MARK}]+")


@cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@cache
def word_tokenizer(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def has_word_end_rules(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    cutter = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model, added = told["model"], told.get("added_tokens") or []
    return (
        told.get("normalizer") == WORD_END_RULES["normalizer"] and cutter[0].get("pattern") == {"Regex": WORD_END_RULES["pieces"]} and cutter[0].get("behavior") == "Removed"
        and [c.get("type") for c in cutter[1:]] == ["ByteLevel"] and not cutter[1].get("add_prefix_space") and not cutter[1].get("use_regex") and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == WORD_END_RULES["suffix"] and not model.get("dropout") and not model.get("ignore_merges") and all(t["content"].startswith("<|") for t in added)
    )


class WordEncoder:
    """Ids by the tokenizers library as little-endian 32-bit words; None for chunks whose text must go to it whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.pieces, self.by_chunks = word_tokenizer(path), Kept(PIECES_KEPT), has_word_end_rules(path)
        self.letters = {b: c for b, c in enumerate(byte_letters())}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of plain characters; their pieces are cut in one pass, and each new one is contracted once."""
        flat = _PIECES.findall(MARK.join(chunks).lower())
        new, tokenize = self.pieces.missing({*flat}), self.tokenizer.model.tokenize
        known = self.pieces.new
        for p in new:
            letters = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in tokenize(letters)]
            known[p] = struct.pack(f"<{len(ids)}I", *ids)
        known[MARK] = None
        out, part = [], []
        for packed in map(known.__getitem__, flat):
            if packed is None:
                out.append(part[0] if len(part) == 1 else b"".join(part))
                part = []
            else:
                part.append(packed)
        return [*out, b"".join(part)]

    def chunks(self, chunks: list[str]) -> dict[str, bytes | None]:
        if not self.by_chunks:
            return dict.fromkeys(chunks)
        joined = "".join(chunks)
        if PLAIN.fullmatch(joined) and "<|" not in joined:
            return dict(zip(chunks, self.plain(chunks), strict=True))
        out: dict[str, bytes | None] = dict.fromkeys(chunks)
        plain = [c for c in chunks if "<|" not in c and PLAIN.fullmatch(c)]
        if plain:
            out.update(zip(plain, self.plain(plain), strict=True))
        return out
