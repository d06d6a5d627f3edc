"""Secrets in texts: fixed patterns, and strings that zstandard cannot explain from their surroundings.

The base kinds are patterns. Besides these, a long string shortly before or after a
sensitive word is a candidate: the text around it is compressed with and
without it, after a dictionary of the corpus' own identifiers. Marginal bytes
depend on length, alphabet and surroundings, so a candidate is compared with
random strings of its own length and alphabet in its own place, and is reported
as ``novel`` when it costs about what they cost. Up to some 20 characters unseen
names cost as much as random letters, so what reads like a name is not reported.

The dictionary holds the most frequent identifiers of all documents that read
like names; its entries are a fixed number.

Spans are whole matches in code points, the end excluded. Defined results:
null and empty texts have no spans; null keys and repeated rows are scanned as
they are; empty tables give no rows and a dictionary without entries; other
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgate.llm.common import once_a_task, tidy

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

SENSITIVE_WORDS = (*ASSIGN_WORDS, "credential", "bearer", "private", "access", "auth", "key", "login", "passphrase", "signature")
_SENSITIVE = re.compile("(?ai)" + "|".join(sorted(SENSITIVE_WORDS, key=len, reverse=True)))
LEAST_RUN = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: A candidate begins at most so many characters after the end of a sensitive word, or ends as many before its start.
REACH = 48
#: Characters on each side that count as surroundings.
AROUND = 96
#: Ends what is compressed, since zstandard does not look for matches in its last bytes.
TAIL = b"\n.\t;" * 4
#: Least share of the marginal bytes of random strings, and bytes that a random string may miss by chance matches.
LEAST_SHARE, CHANCE_BYTES = 0.95, 3
#: Random strings for each candidate; long ones vary less, so one is enough from ``RANDOM_CHARS`` on.
RANDOM_STRINGS, RANDOM_CHARS = 8, 512
#: Letter pairs frequent in names; those of the dictionary come on top.
PAIRS = frozenset("""th he in er an re nd on at en es ed te ti or st ar to it is ng as io le nt al et se ha ou me ve ea
    ro co de ra li ri ic ne el la ce ch om us ss il ac ec ct pe ma tr ge lo ur di ns na so si pa ut ad""".split())
#: A string reads like a name when at least this share of its neighbouring characters are such pairs.
NAME_SHARE = 0.45
#: Names without digits, so that no candidate explains itself.
IDENTIFIER = r"[A-Za-z_][A-Za-z_.-]{7,31}"
IDENTIFIERS = 4096
_HEX_RUNS = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


def identifier_dictionary(docs: DataFrame, text: str = "text", entries: int = IDENTIFIERS) -> bytes:
    """The most frequent identifiers of all documents, the most frequent last, where matches cost least.

    Of twice as many, those that do not read like names give way, so that no random letters explain themselves.
    """
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(IDENTIFIER), F.lit(0))).alias("w"))
    top = found.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(2 * entries).collect()
    pairs = name_pairs(r.w for r in top)
    return " ".join([r.w for r in top if reads_like_name(r.w, pairs)][:entries][::-1]).encode().rjust(8)


def _pairs(text: str) -> list[str]:
    """Neighbouring letters without regard to case, but for capitals after small letters, where names join."""
    return [(a + b).lower() for a, b in zip(text, text[1:]) if a.isalpha() and b.isalpha() and not (a.islower() and b.isupper())]


def name_pairs(names: Iterable[str]) -> frozenset[str]:
    """Letter pairs frequent in names, and those that every twentieth of ``names`` has, three at least."""
    each = [set(_pairs(n)) for n in set(names)]
    seen = Counter(p for pairs in each for p in pairs)
    return PAIRS | {p for p, n in seen.items() if n >= max(3, len(each) / 20)}


def reads_like_name(text: str, pairs: frozenset[str]) -> bool:
    """Pairs with a sign do not count, as signs part the words of a name."""
    all_pairs = sum(a.isalnum() and b.isalnum() for a, b in zip(text, text[1:]))
    return all_pairs > 0 and sum(p in pairs for p in _pairs(text)) >= NAME_SHARE * all_pairs


def _alphabet(own: str) -> str:
    """Digits, hex or all letters of each case, and single signs, as far as ``own`` has them."""
    parts = [string.digits] if any(c.isdigit() for c in own) else []
    hexed = all(c in string.hexdigits for c in own if c.isalpha()) and bool(parts)
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        if any(c in letters for c in own):
            parts.append(letters[:6] if hexed else letters)
    return "".join(parts) + "".join(sorted({c for c in own if not c.isalnum()}))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its length."""
    out, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"h" * LEAST_HEX in text.encode("utf-8", "replace").translate(_HEX_RUNS):  # runs of 24 at once, then their places
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return out


def candidates(text: str) -> set[tuple[int, int]]:
    """Strings that begin at most ``REACH`` characters after a sensitive word or end as shortly before one; a word cuts a run."""
    out: set[tuple[int, int]] = set()
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    starts, ends = [a for a, _ in runs], [b for _, b in runs]
    for word in _SENSITIVE.finditer(text):
        a, b = word.span()
        for start, end in runs[bisect_right(ends, a - REACH - 1):bisect_right(starts, b + REACH)]:
            if start < a and end > a:  # the run goes into the word
                end, rest = a, end
                out |= {(b, rest)} if rest - b >= LEAST_RUN else set()
            elif a <= start < b:
                start = b
            if end - start >= LEAST_RUN:
                out.add((start, end))
    return out


class Novelty:
    def __init__(self, dictionary: bytes):
        self.compress = zs.ZstdCompressor(
            level=9, dict_data=zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT),
            write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.pairs = name_pairs(dictionary.decode().split())

    def is_novel(self, text: str, start: int, end: int) -> bool:
        """Whether ``text[start:end]`` adds about as many compressed bytes as random strings in its place."""
        own = text[start:end]
        alphabet = _alphabet(own)
        if len(set(own)) == 1 or reads_like_name(own, self.pairs):
            return False
        before, after = text[max(0, start - AROUND):start].encode(), text[end:end + AROUND].encode() + TAIL
        bare = len(self.compress(before + after))
        cost = lambda s: len(self.compress(before + s.encode() + after)) - bare
        r = random.Random(own)  # the same strings in every run
        count = max(1, min(RANDOM_STRINGS, RANDOM_CHARS // len(own)))
        drawn = ("".join(r.choices(alphabet, k=len(own))) for _ in range(count))
        return cost(own) >= LEAST_SHARE * sum(map(cost, drawn)) / count - CHANCE_BYTES

    def spans(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        low = text.lower()
        if not any(w in low for w in SENSITIVE_WORDS):
            return []
        held = sorted((a, b) for _, a, b in taken)
        good = [c for c in sorted(candidates(text)) if not any(a < c[1] and c[0] < b for a, b in held) and self.is_novel(text, *c)]
        out = []
        for start, end in sorted(good, key=lambda c: (c[0] - c[1], c)):  # the longest of those that overlap
            if not any(a < end and start < b for _, a, b in out):
                out.append(("novel", start, end))
        return out


def all_spans(text: str, novelty: Novelty) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return sorted(base + novelty.spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, dictionary: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)`` of every document, by start and then by kind; narrow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in all_spans(t.as_py() or "", novelty)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(tidy(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, dictionary: bytes, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; spans that overlap become one."""
    novelty = once_a_task(__name__, lambda: Novelty(dictionary))

    @F.udf("string", useArrow=False)
    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, at = [], 0
        for _, a, b in sorted(all_spans(value, novelty()), key=lambda s: s[1:]):
            if a >= at:
                out += [value[at:a], mark]
            at = max(at, b)
        return "".join([*out, value[at:]])

    return docs.withColumn(text, clean(F.col(text)))
