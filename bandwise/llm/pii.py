"""Personal data by bootstrapped contextual extraction.

1. *Base entities.* Fixed patterns find emails, IPv4 addresses, card and phone numbers in whole texts.
   They are always reported and are the seeds.
2. *Candidates.* Every other string that could fill a slot: a run without white space that holds a
   digit or an @, numeric runs one space apart as one, and addresses spelt with [at] and [dot]. What a candidate is follows
   from the slot, not from its shape; all that is asked of it is an @ or [at] (email), 4 digits (ip), 7 digits
   (phone) or 12 digits (card). A string that could be none of these is no candidate.
3. *Patterns.* The 1, 2 and 3 tokens before an entity on its line, those after it, and 1 and 2 on both
   sides together, lower-cased, digits as 0: eight patterns at most, from general to special, so that a
   rare long context backs off to a shorter one. Tokens of any length count whole.
4. *Graph.* Distinct (pattern, instance) pairs. A pattern's score for a kind is the sum of its instances'
   scores for that kind over the number of all its instances (an unknown one and one of another kind
   count 0). Seeds have score 1. A pattern with a sum of at least ``min_seeds`` and a score of at least
   ``min_score`` is confident: the instances in its slots that could be of its kind and are no seeds get
   its score (the greatest of their patterns), and so support further patterns in the next round. Rounds go on
   until none discovers an instance; an instance's score is that of the round that discovered it.
   Scores are whole millionths, so sums do not depend on the order.
5. *Spans.* A candidate in a slot of a confident pattern becomes a span of the kind with the best score (ties:
   the order of KINDS).

Sums are grouped with partial aggregation, never lists, whatever the instances of a pattern or the patterns of an instance.
Patterns with fewer than ``min_seeds`` instances can never be confident and leave the graph at first.

Texts are read once; what is kept per document is its spans and candidates. Missing and odd input: a
null text is empty and has no span; rows with the same id stay separate rows, ids may be null; an
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.graph import measured
from bandwise.session import cut_lineage

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# (?<![0-9]): inside a run of digits a start that fails at the run's head fails as well
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT_AT = re.compile(r"[\x20]?[\[(](?:at|AT)[\])][\x20]?")
_SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[\x20]?[\[(](?:dot|DOT)[\])][\x20]?)[A-Za-z0-9-]+)+")
_MARK = re.compile(r"[0-9@]")
_REST = re.compile(r"\S*")
_NUMERIC = re.compile(r"[0-9().+-]+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Digits that a candidate needs to be of a kind.
LEAST = {"ip": 4, "card": 12, "phone": 7}
ONE = 1_000_000  # a score of 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@domain(.domain)+``, in linear time.

    The local part is the run of its characters before the @, cut at the end of the match before.
    """
    end, seen = 0, 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        left = text[max(end, seen): at]
        n = len(left) - len(left.rstrip(_LOCAL))
        seen = at + 1
        if n:
            end = m.end()
            yield at - n, end


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in code points, by start, then in the order of KINDS."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _overlaps(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether [a, b) meets one of the disjoint ascending spans."""
    i = bisect_right(starts, a)
    return (i > 0 and ends[i - 1] > a) or (i < len(starts) and starts[i] < b)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """[a, b) without the punctuation around it; a bracket stays if its other half is inside."""
    while a < b and not (text[a].isalnum() or text[a] in "_+(@"):
        a += 1
    while b > a and not (text[b - 1].isalnum() or text[b - 1] in "_)"):
        b -= 1
    if a < b and text[a] == "(" and ")" not in text[a:b]:
        a += 1
    if a < b and text[b - 1] == ")" and "(" not in text[a:b]:
        b -= 1
    return a, b


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _SPELT_AT.finditer(text):
        domain = _SPELT_DOMAIN.match(text, m.end())
        left = text[end: m.start()] if m.start() >= end else ""
        n = len(left) - len(left.rstrip(_LOCAL))
        if domain and n:
            yield m.start() - n, domain.end()
            end = domain.end()
        else:
            end = max(end, m.end())


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Trimmed runs without white space that hold a digit or an @; numeric ones one space apart are one."""
    end, held, numeric = 0, None, False
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        end = _REST.match(text, m.start()).end()
        a, b = _trimmed(text, a, end)
        number = _NUMERIC.fullmatch(text, a, b) is not None
        if held and numeric and number and text[held[1]: a] == " ":
            held = held[0], b
            continue
        if held:
            yield held
        held, numeric = ((a, b) if a < b else None), number
    if held:
        yield held


def core(s: str) -> str:
    """An instance as written in any way: lower case, without spaces, brackets, hyphens and plus signs."""
    return re.sub(r"[\s()\[\]+-]", "", s.lower())


def may_be(s: str, spelt: bool) -> list[str]:
    """The kinds that a candidate could be."""
    digits = sum("0" <= c <= "9" for c in s)
    return [k for k in KINDS if (spelt or "@" in s if k == "email" else digits >= LEAST[k])]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """Strings that overlap no base span and could be personal data: ``(start, end, kinds)``."""
    starts, ends = [], []
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    spelt = [] if "[" not in text and "(" not in text else [x for x in _spelt(text) if not _overlaps(starts, ends, *x)]
    own = [a for a, _ in spelt], [b for _, b in spelt]
    out = [(a, b, may_be(text[a:b], True)) for a, b in spelt]
    for a, b in _runs(text):
        if not _overlaps(starts, ends, a, b) and not _overlaps(*own, a, b) and (kinds := may_be(text[a:b], False)):
            out.append((a, b, kinds))
    return out


def _short(token: str) -> str:
    """A token, or the digest that stands for a very long one."""
    return token if len(token) <= 64 else hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()


def _before(text: str, at: int) -> list[str]:
    """The last three tokens before ``at`` on its line."""
    size = 64
    while True:
        part = text[max(0, at - size): at]
        line = part.rpartition("\n")[2]
        tokens = _TOKEN.findall(line)
        if len(tokens) > 3 or size >= at or len(line) < len(part):  # the first token may be cut
            return tokens[-3:]
        size *= 4


def _after(text: str, at: int) -> list[str]:
    size = 64
    while True:
        part = text[at: at + size]
        line = part.partition("\n")[0]
        tokens = _TOKEN.findall(line)
        if len(tokens) > 3 or at + size >= len(text) or len(line) < len(part):
            return tokens[:3]
        size *= 4


def patterns(text: str, start: int, end: int) -> list[str]:
    """The contexts of [start, end), general ones first; ``_`` is the slot."""
    fold = lambda ts: [re.sub(r"\d", "0", _short(t.lower())) for t in ts]
    left, right = fold(_before(text, start)), fold(_after(text, end))
    out = [" ".join(left[-n:]) + " _" for n in range(1, len(left) + 1)]
    out += ["_ " + " ".join(right[:n]) for n in range(1, len(right) + 1)]
    return out + [" ".join(left[-n:]) + " _ " + " ".join(right[:n]) for n in (1, 2) if min(len(left), len(right)) >= n]


_HITS = "array<struct<start: long, end: long, kind: string, may: array<string>, patterns: array<string>, instance: string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("may", pa.list_(pa.string())),
                     ("patterns", pa.list_(pa.string())), ("instance", pa.string())])
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            rows = batch.slice(at, 100)
            hits, digest = [], []
            for t in rows.column("text"):
                t = t.as_py() or ""
                base = base_spans(t)
                digest.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest())
                found = [(a, b, k, []) for a, b, k in base] + [(a, b, None, may) for a, b, may in candidates(t, base)]
                hits.append([{"start": a, "end": b, "kind": k, "may": may, "patterns": patterns(t, a, b), "instance": _short(core(t[a:b]))}
                             for a, b, k, may in found])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(digest), pa.array(hits, pa.list_(hit))], ["doc_id", "base_sha256", "hits"])


def bootstrap(seen: DataFrame, min_seeds: int = 3, min_score: float = 0.8) -> DataFrame:
    """``(pattern, kind, score)`` of the confident patterns, score in millionths.

    ``seen(pattern, instance, kind, may)``: one row for each occurrence and pattern; ``kind`` is a seed's
    kind, null for a candidate, ``may`` a candidate's possible kinds.
    """
    edges = cut_lineage(seen.groupBy("pattern", "instance").agg(F.max("may").alias("may")))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_seeds)
    seeds = cut_lineage(seen.filter("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(ONE).cast("long")))
    sizes = measured(cut_lineage(sizes), 96)
    edges = cut_lineage(edges.join(sizes, "pattern"))
    # a seed's kind is settled; other instances can be what their candidates could be
    settled = measured(seeds.select("instance").distinct(), 64)
    open_ = cut_lineage(edges.join(settled, "instance", "left_anti").select("pattern", "instance", "may"))
    known = seeds
    while True:
        score = F.floor(F.sum("score") / F.first("n")).cast("long")
        good = edges.join(measured(known, 80), "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), score.alias("score"))
        good = good.filter((F.col("sum") >= min_seeds * ONE) & (F.col("score") >= min_score * ONE)).select("pattern", "kind", "score")
        good = cut_lineage(good)
        new = open_.join(measured(good, 112), "pattern").filter(F.array_contains("may", F.col("kind")))
        new = new.groupBy("instance", "kind").agg(F.max("score").alias("score"))
        new = cut_lineage(new.join(measured(known.select("instance", "kind"), 80), ["instance", "kind"], "left_anti"))
        if new.isEmpty():
            return good
        known = cut_lineage(known.unionByName(new))


def find_personal_data(docs: DataFrame, min_seeds: int = 3, min_score: float = 0.8) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts, base digest, ``spans`` and ``found``.

    ``spans`` holds base and discovered spans as kind:start:end, by start, then in the order of KINDS;
    ``found`` counts the discovered ones. ``min_seeds``, ``min_score``: see the module.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id long, base_sha256 string, hits {_HITS}")
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    seen = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    good = measured(bootstrap(seen, min_seeds, min_score), 112)
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    new = seen.filter("kind is null").drop("kind").join(good, "pattern").filter(F.array_contains("may", F.col("kind")))
    best = F.max(F.struct(F.col("score"), (-rank[F.col("kind")]).alias("rank"), F.col("kind"))).alias("best")
    new = new.groupBy("row", "start", "end").agg(best)
    new = new.groupBy("row").agg(F.collect_list(F.struct("start", "end", F.col("best.kind").alias("kind"))).alias("new"))  # one document's spans
    out = rows.join(new, "row", "left")
    seeds = F.filter("hits", lambda h: h["kind"].isNotNull())
    base = F.transform(seeds, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["kind"].alias("kind")))
    every = F.concat(base, F.coalesce("new", F.array().cast("array<struct<start: long, end: long, kind: string>>")))
    keyed = F.array_sort(F.transform(every, lambda h: F.struct(h["start"].alias("a"), rank[h["kind"]].alias("k"), h["end"].alias("b"), h["kind"].alias("kind"))))
    spans = F.array_join(F.transform(keyed, lambda h: F.concat_ws(":", h["kind"], h["a"], h["b"])), ",")
    count = lambda k: F.size(F.filter("hits", lambda h: h["kind"].eqNullSafe(F.lit(k)))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], "base_sha256", spans.alias("spans"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("found"))
