"""Token ids of whole texts by the tokenizers library, looked up per white-space chunk.

For tokenizers of the form FORM, no token crosses white space and the ids of a chunk do
not depend on its neighbours. So each distinct chunk is encoded once by the library and
texts are joined from a bounded cache. Texts outside the provable range (characters from
U+0300 on, where normalisation may combine; U+001C to U+001F, which Python and the
tokenizer split differently; possible special tokens) go to the library whole, as do all
texts for tokenizers of any other form.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .shared import worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The normaliser and splitter for which chunks are independent.
FORM = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: Distinct chunks, and distinct words, kept by a worker.
CACHE_CHUNKS = 400_000

_odd = re.compile("[̀-\U0010ffff]")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def independent_chunks(spec: dict) -> bool:
    """Whether the tokenizer has the form for which chunks can be encoded one by one."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = spec.get("model") or {}
    return (
        spec.get("normalizer") == FORM["normalizer"]
        and len(pre) == 2
        and pre[0].get("pattern") == {"Regex": FORM["split"]}
        and pre[0].get("behavior") == "Removed"
        and pre[0].get("invert") is True
        and pre[1].get("type") == "ByteLevel"
        and pre[1].get("add_prefix_space") is False
        and pre[1].get("use_regex") is False
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all(not t.get("normalized") and "<|" in t["content"] for t in spec.get("added_tokens", []))
    )


def plain(text: str) -> bool:
    """Whether the chunks of text, lower-cased, are encoded alike alone and in place."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _odd.search(text):
                return False
    return not ("<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)


class Kept(dict):
    """A cache that keeps what came first, which holds what is frequent; it starts anew once it has
    turned away as many entries as it holds."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.away = limit, 0

    def put(self, key: str, value: bytes) -> None:
        if len(self) < self.limit:
            self[key] = value
        else:
            self.away += 1
            if self.away > self.limit:
                self.clear()
                self.away = 0


class ChunkEncoder(Kept):
    """Maps a lower-cased chunk to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, spec_json: str, limit: int = CACHE_CHUNKS):
        import regex
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_str(spec_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = independent_chunks(json.loads(spec_json))
        self.words = Kept(limit)
        self.split = regex.compile(FORM["split"]).findall
        self.letters = dict(enumerate(byte_letters()))
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        out = []
        for word in (chunk,) if chunk.isalpha() else self.split(chunk):
            ids = self.words.get(word)
            if ids is None:
                found = self.merge(word.encode().decode("latin-1").translate(self.letters))
                ids = array("I", [t.id for t in found]).tobytes()
                self.words.put(word, ids)
            out.append(ids)
        ids = b"".join(out)
        self.put(chunk, ids)
        return ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; null has none."""
        if not text:
            return b""
        if self.fast and plain(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return self.whole(text)


def worker_encoder(spec_json: str) -> ChunkEncoder:
    """The encoder of this Python worker; tasks on the same worker share its cache."""
    return worker_state(("chunks", hash(spec_json)), lambda: ChunkEncoder(spec_json))
