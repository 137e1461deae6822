"""Personal data: base patterns and bootstrapped contextual extraction.

Base matches are the seeds.  What stands around a seed on its line induces
lexical patterns: two words before it, two after it, one on either side, and two
before it over a gap of one word.  Spark scores the graph of patterns and
instances in rounds: a pattern's confidence in a kind is the smoothed mean
confidence of its distinct instances, an instance's is
1 - prod(1 - confidence) over its sure patterns; seeds stay at 1.  Rounds end
when the sure patterns stay the same.  Candidates are words with digits or @,
and neighbouring groups of digits, that no base match touches.  One that stands
in a sure pattern and could be of its kind by its signs becomes a new span, if
most occurrences of that instance stand in sure patterns of the kind.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, heavy_join, row_id, save

KINDS = ("email", "ip", "card", "phone")
SURE = 0.8
PRIOR = 2.0
ACCEPT = 0.5
ROUNDS = 10
LONGEST = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match starts where its digits do: one that fails there fails at each later digit of the run too.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\n|[^\s]+")
_DIGIT = re.compile(r"[0-9]")
_OUTER = re.compile(r"\A[^\w+@(]+|[^\w)]+\Z")
# what the signs of a candidate allow: a group of digits that a neighbour may join, and the kinds
_GROUP = re.compile(r"[0-9+().-]*[0-9][0-9+().-]*")
_FITS = {
    "email": re.compile(r"[^@\s]+@[^@\s]+"),
    "ip": re.compile(r"[0-9a-fA-F]*(?:[.:][0-9a-fA-F]*){2,}"),
    "card": re.compile(r"(?:[0-9][ -]?){11,18}[0-9]"),
    "phone": re.compile(r"[(+]?(?:[0-9][ ().+-]{0,3}){5,14}[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; a match starts where the run of local characters before an @ does."""
    end, at = 0, text.find("@")
    while at >= 0:
        i = at
        while i > end and text[i - 1] in _LOCAL:
            i -= 1
        if i < at and (m := _EMAIL.match(text, i)):
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then start; failing matches are dropped, not retried."""
    if not _HINT.search(text):
        return []
    out = [("email", i, j) for i, j in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdecimal() for c in m[0]) <= 15]
    return out


def _sign(word: str) -> str:
    """A word as patterns hold it: lower case, digits as 0; very long ones by their digest."""
    return _DIGIT.sub("0", word.lower()) if len(word) <= LONGEST else f"#{xxhash.xxh3_64_hexdigest(word.encode('utf-8', 'surrogatepass'))}"


class Words:
    """The words of a text, line by line, with what stands around a span."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [i for i, _ in self.spans]

    def _word(self, t: int) -> str | None:
        """The word at place t; None at a line's end."""
        if not 0 <= t < len(self.spans):
            return None
        i, j = self.spans[t]
        return None if self.text[i] == "\n" else _sign(self.text[i:j])

    def _beside(self, t: int, step: int, glued: str, n: int) -> list[str]:
        """n words from place t on in one direction, what is glued to the span first; the line's end as one sign."""
        out = [_sign(glued)] if glued else []
        while len(out) < n:
            t += step
            word = self._word(t)
            out.append("|" if word is None else word)
            if word is None:
                break
        return out[:n]

    def patterns(self, start: int, end: int) -> list[str]:
        """The lexical patterns that the span stands in: words before, after, on both sides, and before over a gap."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        left = self._beside(first, -1, self.text[self.spans[first][0] : start], 3)
        right = self._beside(last, 1, self.text[end : self.spans[last][1]], 2)
        out = [f"{left[0]} _ {right[0]}"]
        if left[0] != "|":
            out.append(" ".join(left[1::-1]) + " _")
        if right[0] != "|":
            out.append("_ " + " ".join(right))
        if len(left) == 3:
            out.append(f"{left[2]} {left[1]} * _")
        return out

    def candidates(self, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
        """Words with a digit or @, outer punctuation dropped, and neighbouring groups of digits as one, that no base match touches."""
        held = sorted((j, i) for _, i, j in taken)
        at, run = 0, None
        for a, b in self.spans:
            word = self.text[a:b]
            found = None
            if _HINT.search(word):
                i, j = a, b
                if m := _OUTER.match(word):
                    i = a + m.end()
                while j > i and not (self.text[j - 1].isalnum() or self.text[j - 1] in "_)"):
                    j -= 1
                while at < len(held) and held[at][0] <= i:
                    at += 1
                if not any(x < j for _, x in held[at : at + len(KINDS)]):
                    found = (i, j)
            if run and found and self.text[run[1] : found[0]] == " " and _GROUP.fullmatch(self.text, run[2], run[1]) and _GROUP.fullmatch(self.text, *found):
                run = (run[0], found[1], found[0])
                continue
            if run and run[1] - run[0] >= 4:
                yield run[:2]
            run = (*found, found[0]) if found else None
        if run and run[1] - run[0] >= 4:
            yield run[:2]


def fitting(text: str) -> int:
    """The kinds that the signs of a candidate allow, as bits in the order of KINDS."""
    return sum(1 << n for n, k in enumerate(KINDS) if _FITS[k].fullmatch(text))


_ROW = "row_id long, doc_id long, spans array<struct<kind:string,i:long,j:long>>, seen array<struct<kind:string,i:long,j:long,x:long,fits:int,patterns:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("i", pa.int64()), ("j", pa.int64())])
    seen_type = pa.struct([*span, ("x", pa.int64()), ("fits", pa.int32()), ("patterns", pa.list_(pa.string()))])
    for b in batches:
        spans, seen = [], []
        for t in b.column("text"):
            text = t.as_py() or ""
            own = base_spans(text)
            spans.append([{"kind": k, "i": i, "j": j} for k, i, j in own])
            rows = []
            if _HINT.search(text):
                words = Words(text)
                for k, i, j in [*own, *((None, i, j) for i, j in words.candidates(own))]:
                    instance = text[i:j].lower()
                    x = xxhash.xxh3_64_intdigest(instance.encode("utf-8", "surrogatepass"))
                    rows.append({"kind": k, "i": i, "j": j, "x": x - (x >> 63 << 64), "fits": fitting(instance), "patterns": words.patterns(i, j)})
            seen.append(rows)
        yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(seen, pa.list_(seen_type))], ["row_id", "doc_id", "spans", "seen"])


def sure_patterns(seen: DataFrame, rounds: int = ROUNDS, sure: float = SURE, prior: float = PRIOR) -> DataFrame:
    """pattern, degree and its confidence in each kind (0 where it isn't sure) once the sure patterns stay the same.

    ``seen``: (pattern, x, kind, fits) with instance x; kind is null and fits
    holds the possible kinds for candidates.  Confidences only grow, so the
    rounds end; ``rounds`` bounds them.
    """
    edges = save(seen.groupBy("pattern", "x").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits")), "pii-edges")
    degree = save(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("degree")), "pii-degrees")
    instances = edges.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"), F.max("fits").alias("fits"))
    instances = save(instances, "pii-instances")
    seeds = instances.where("kind is not null").select("x", "n", *((F.col("kind") == k).cast("double").alias(k) for k in KINDS))
    belief, state, patterns = seeds, None, None
    for _ in range(rounds):
        mass = heavy_join(edges.select("pattern", "x"), belief, "x", "n").groupBy("pattern").agg(*(F.sum(k).alias(k) for k in KINDS))
        confidence = lambda k: F.col(k) / (F.col("degree") + prior)
        scored = mass.join(degree, "pattern").select("pattern", "degree", *(F.when(confidence(k) >= sure, confidence(k)).otherwise(0.0).alias(k) for k in KINDS))
        patterns = save(scored.where(F.greatest(*KINDS) > 0), "pii-patterns")
        now = patterns.agg(F.count(F.lit(1)), F.round(F.sum(sum((F.col(k) for k in KINDS), F.lit(0.0))), 3)).first()
        if now == state or not now[0]:
            break
        state = now
        told = heavy_join(edges.where("kind is null").select("pattern", "x"), patterns, "pattern", "degree")
        inferred = told.groupBy("x").agg(*((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col(k), F.lit(1e-9)))))).alias(k) for k in KINDS))
        own = [(F.col(k) * F.col("fits").bitwiseAND(1 << n).cast("boolean").cast("double")).alias(k) for n, k in enumerate(KINDS)]
        inferred = inferred.join(instances.where("kind is null").select("x", "n", "fits"), "x").select("x", "n", *own)
        belief = save(seeds.unionByName(inferred), "pii-belief")
    discard(edges, degree)
    return patterns


def find_personal_data(docs: DataFrame, sure: float = SURE, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """One row per document: row_id, doc_id, base and spans (arrays of struct kind, i, j).

    ``base`` holds the base matches, ``spans`` these and the added ones, both by
    kind as listed, then start.  A candidate that sure patterns give several
    kinds gets the surest (ties: first as listed).  Null and empty texts have no
    spans; a text and its words may have any length.  Only doc_id and text are
    read; rows that repeat a doc_id are read each; an empty table gives no rows.
    """
    src = docs.select(row_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = save(src.mapInArrow(_scan, _ROW), "pii-rows")
    seen = rows.select("row_id", F.explode("seen").alias("o")).select("row_id", "o.*")
    patterns = sure_patterns(seen.select(F.explode("patterns").alias("pattern"), "x", "kind", "fits"), rounds, sure)
    # the surest kind of each candidate that stands in a sure pattern
    maybe = seen.where("kind is null and fits > 0")
    told = heavy_join(maybe.select("row_id", "i", "j", "x", "fits", F.explode("patterns").alias("pattern")), patterns, "pattern", "degree")
    best = F.max(F.greatest(*(F.struct((F.col(k) * F.col("fits").bitwiseAND(1 << n).cast("boolean").cast("double")).alias("c"), F.lit(-n).alias("n")) for n, k in enumerate(KINDS))))
    told = save(told.groupBy("row_id", "i", "j", "x").agg(best.alias("best")).where("best.c > 0"), "pii-told")
    # of an instance's occurrences enough have to stand in sure patterns of the kind
    flagged = told.groupBy("x", "best.n").agg(F.count(F.lit(1)).alias("flagged"))
    total = maybe.groupBy("x").agg(F.count(F.lit(1)).alias("total"))
    taken = flagged.join(total, "x").where(F.col("flagged") >= accept * F.col("total")).groupBy("x").agg(F.collect_list("n").alias("kinds"), F.max("total").alias("total"))
    added = heavy_join(told, taken, "x", "total").where(F.array_contains("kinds", F.col("best.n")))
    kinds = F.array(*map(F.lit, KINDS))
    new = added.groupBy("row_id").agg(F.collect_list(F.struct(kinds[-F.col("best.n")].alias("kind"), "i", "j")).alias("new"))
    place = F.create_map(*(x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))))
    joined = F.concat("spans", F.coalesce("new", F.array().cast("array<struct<kind:string,i:bigint,j:bigint>>")))
    ordered = F.transform(F.array_sort(F.transform(joined, lambda s: F.struct(place[s["kind"]].alias("k"), s["i"].alias("i"), s["j"].alias("j"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["i"].alias("i"), s["j"].alias("j")))
    return rows.join(new, "row_id", "left").select("row_id", "doc_id", F.col("spans").alias("base"), ordered.alias("spans"))


def spans_text(col: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(F.col(col), lambda s: F.concat_ws(":", s["kind"], s["i"].cast("string"), s["j"].cast("string"))), ",")
