"""Sentence boundaries across languages and scripts: maximum entropy over candidate boundaries.

A text's layout comes first: blank lines, headings, list items and line ends that no wrapping explains end a
unit. Within a unit every end mark (with its closing marks), and in Thai every space, is a candidate. A
logistic (maximum-entropy) model decides, from the neighbouring tokens, their case, length, digits and script,
and from how the corpus uses them: how often a token carries a full stop, ends or begins a paragraph, or
follows a closed quotation. These statistics cover all documents; those of tokens rarer than one candidate in
``VOCAB_ONE_IN`` count as unknown. The model is trained on the reliable candidates of at most ``TRAIN``
rows, taken by the hash of their place: paragraph ends, and marks followed by what cannot begin a sentence.

Null, empty and blank texts have no sentences. Texts are taken whole, whatever their length. Repeated doc_ids
count once. A corpus without a reliable boundary is split at the marks that need no model.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

VOCAB_ONE_IN, TRAIN, DIM = 200_000, 40_000, 1 << 15
#: reliable candidates that a document is taken to have at least, when documents are drawn for training
DOC_HAS = 8
EPOCHS, PENALTY = 150, 1e-5
CLOSERS = "”\"’'“»)\\]）】』」》›"
FIRM = "”’»)\\]）】』」》›"
OPENERS = "“\"‘'«([（【『「《‹„¿¡"
MARKS = re.compile(rf"[.!?。！？．؟।…]+(?:[\s  ]»|[{FIRM}]|[\"'“](?=[\s,.;:!?)»]|$))*(?:[.。](?=\s|$))?")
WIDE = "。！？．"
BULLET = re.compile(r"\s*(?:[-*•·–]\s|・|（\d{1,3}）)")
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
SPACE = re.compile(r"\s")
DIGIT = re.compile(r"\d")
RUN = re.compile(r" +")
THAI = re.compile("[\u0e00-\u0e7f]")
#: where a token of running letters stops
WIDE_OR_STOP = re.compile("[\u3040-\u30ff\u3400-\u9fff\uff00-\uffef「」『』《》【】“”〈〉。]")
MARK_CHARS = frozenset(".!?。！？．؟।…")
CLOSE_CHARS = frozenset("”\"’'“»)]）】』」》›")
OPEN_CHARS = frozenset(OPENERS)
TRAILING = CLOSE_CHARS | frozenset(",;:，、；：")
MARK_STRIP = "".join(CLOSE_CHARS) + " \u00a0\u202f"
CLAUSE = re.compile(r"[.!?。！？．؟।…；，]")
GLUED = re.compile(rf"[{OPENERS}]*\w?[^\W\d_A-Z]{{2,}}")
ITEM = re.compile(r"(?:[-*•·–—]\s|・|[(（]?\d{1,3}[.)）])\s*")
BRACKET = re.compile(r"[“”«»()（）「」『』《》„\[\]【】]")
EDGES = re.compile(rf"^[{OPENERS}]+|[{CLOSERS},;:，、；：]+$")


def is_wide(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "＀" <= c <= "￯" or c in "「」『』《》【】“”〈〉"


def is_thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def units(text: str) -> list[tuple[int, int]]:
    """The spans that layout alone separates: paragraphs, headings and list items.

    A line end is the work of wrapping if the next line's first word would not have fitted the usual width.
    """
    out, at = [], 0
    paragraphs = []
    for m in BLANK.finditer(text):
        paragraphs.append((at, m.start()))
        at = m.end()
    paragraphs.append((at, len(text)))
    lengths = sorted(len(x.strip()) for a, b in paragraphs for x in text[a:b].split("\n")[:-1])
    width = lengths[-1] if lengths else 0
    if len(lengths) > 2 and width > 1.2 * lengths[-2]:
        width = lengths[-2]  # one line, an address perhaps, sticks out
    for a, b in paragraphs:
        start, line = a, a
        while (end := text.find("\n", line, b)) >= 0:
            stop = text.find("\n", end + 1, b)
            here, follow = text[line:end].strip(), text[end + 1 : stop if stop >= 0 else b].lstrip()
            first = follow[:1] if follow and is_wide(follow[0]) else (follow.split(None, 1) or [""])[0]
            wrapped = 40 <= width <= 120 and len(here) + 1 + len(first) > width or follow[:1].islower() and _class(first) == "lower" and len(here) > 30
            if BULLET.match(follow) or not wrapped:
                out.append((start, end))
                start = end + 1
            line = end + 1
        out.append((start, b))
    trimmed = []
    for a, b in out:
        s = text[a:b]
        left, right = len(s) - len(s.lstrip()), len(s.rstrip())
        if right > left:
            trimmed.append((a + left, a + right))
    return trimmed


def flat(text: str) -> str:
    """The text with a plain space for every white space, place by place."""
    return SPACE.sub(" ", text)


def _key(token: str) -> str:
    """A token as the statistics know it: lower case, digits as #; of running wide or Thai text only the near end counts."""
    return token.lower() if token.isalpha() else DIGIT.sub("#", token.lower())


def _bare(token: str) -> str:
    return EDGES.sub("", token) if token and (token[0] in OPEN_CHARS or token[-1] in TRAILING) else token


def _before(text: str, a: int, at: int) -> str:
    """The token that ends at ``at`` of a flat text; of wide text the last two characters, of Thai the last five."""
    while at > a and text[at - 1] in CLOSE_CHARS:
        at -= 1
    if at > a and is_wide(text[at - 1]):
        return _bare(text[at - 2 if at - 1 > a and is_wide(text[at - 2]) else at - 1 : at])
    i = text.rfind(" ", a, at)
    token = text[a if i < 0 else i + 1 : at]
    if not token.isascii() and (m := WIDE_OR_STOP.search(token[::-1])):
        token = token[len(token) - m.start() :]
    token = _bare(token)
    return token[-5:] if token and is_thai(token[-1]) else token


def _after(text: str, at: int, b: int) -> str:
    """The token that begins at ``at`` of a flat text, without opening marks."""
    i = at
    while i < b and text[i] in OPEN_CHARS:
        i += 1
    if i < b and is_wide(text[i]):
        token = text[i : i + 2 if i + 1 < b and is_wide(text[i + 1]) else i + 1]
    else:
        j = text.find(" ", i, b)
        token = text[i : b if j < 0 else j]
        if not token.isascii() and (m := WIDE_OR_STOP.search(token)):
            token = token[: m.start()]
    if token and is_thai(token[0]):
        return token[:5]
    if not token or token[-1].isalnum() and token[0] not in OPEN_CHARS:
        return token
    if token[-1] == "." and token[:-1].isdigit():
        return token
    return _bare(token).rstrip(".,;:!?") or token


def _clause_end(text: str, at: int, b: int) -> str:
    """The last word of the clause that begins at ``at`` (the last two characters of a wide one)."""
    m = CLAUSE.search(text, at, b)
    return _before(text, at, m.start() if m else b)


def candidates(text: str, a: int, b: int) -> list[tuple]:
    """(end, next start, mark, whether it is closed, token before, token after, clause end, raw next character, whether the token before begins a sentence) within a unit of a flat text."""
    out, seen = [], set()
    for m in MARKS.finditer(text, a, b):
        end, at, whole = m.end(), m.start(), m[0]
        if end >= b:
            continue
        mark = whole.rstrip(MARK_STRIP) or whole
        closed = bool(whole[len(mark) :].strip())
        nxt, start = text[end], end
        if nxt != " ":
            if mark[-1] in WIDE:
                if mark == "．" and at > a and text[at - 1].isdigit() and nxt.isdigit():
                    continue
            elif nxt.isupper() and mark == "." and not closed and _glued(text, at, a):
                pass  # the space after a full stop is missing
            elif not (mark[-1] in "!?…" or closed) or not is_wide(nxt):
                continue
        else:
            start = RUN.match(text, end, b).end()
            if start >= b:
                continue
        token = _before(text, a, at)
        k = at - len(token)
        while k > a and text[k - 1] == " ":
            k -= 1
        fresh = k <= a or text[k - 1] in ".!?。！？．।…"
        shown = token + ")" if at > 0 and text[at - 1] in ")）" else token
        out.append((end, start, mark[-1] if mark[-1] != "." or len(mark) < 3 else "…", closed, shown, _after(text, start, b), _clause_end(text, start, b) if closed else "", text[start], fresh))
        seen.add(start)
    if THAI.search(text, a, b):
        for m in RUN.finditer(text, a, b):
            if m.end() not in seen and a < m.start() and m.end() < b and (is_thai(text[m.start() - 1]) or is_thai(text[m.end()])):
                out.append((m.start(), m.end(), " ", False, _before(text, a, m.start()), _after(text, m.end(), b), "", text[m.end()], False))
        out.sort()
    return out


def _glued(text: str, at: int, a: int) -> bool:
    """Whether a word of lower-case letters, no part of an address, ends at ``at``."""
    if at - 1 < a or not text[at - 1].isalpha():
        return False
    i = text.rfind(" ", a, at)
    return GLUED.fullmatch(text, a if i < 0 else i + 1, at) is not None


def junction(text: str, one: tuple[int, int], two: tuple[int, int]) -> tuple | None:
    """The end of one paragraph and the start of the next as if they stood in one: a boundary for certain."""
    (a, b), (start, stop) = one, two
    if BULLET.match(text, a, b) or BULLET.match(text, start, stop) or text[a].isdigit() and b - a < 60:
        return None
    k = b
    while k > a and (text[k - 1] in CLOSE_CHARS or text[k - 1] == " "):
        k -= 1
    at = k
    while at > a and text[at - 1] in MARK_CHARS:
        at -= 1
    if at < k:
        mark, closed = text[at:k], bool(text[k:b].strip())
        return (b, start, mark[-1] if mark[-1] != "." or len(mark) < 3 else "…", closed, _before(text, a, at), _after(text, start, stop), _clause_end(text, start, stop) if closed else "", text[start], False)
    if is_thai(text[start]) and stop - start > 20 and (is_thai(text[b - 1]) or text[b - 1].isdigit()) and b - a > 20:
        return (b, start, " ", False, _before(text, a, b), _after(text, start, stop), "", text[start], False)
    return None


def _script(c: str) -> str:
    if is_thai(c):
        return "th"
    if is_wide(c):
        return "wide"
    if c.isdigit():
        return "digit"
    name = unicodedata.name(c, "?").split(" ")[0]
    return name.lower() if name in ("LATIN", "CYRILLIC", "ARABIC", "DEVANAGARI", "GREEK", "HANGUL", "CJK", "HIRAGANA", "KATAKANA") else "mark"


def _class(c: str) -> str:
    if c.isupper() or len(c) > 1 and c[0].islower() and any(x.isupper() for x in c[1:]):
        return "upper"  # also names like eBook
    c = c[:1]
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if c.isdigit():
        return "digit"
    if c in OPENERS:
        return "open"
    if c.isalpha():
        return "letter"
    return "other"


def _bin(part: float, whole: float, least: int = 2) -> int:
    """-1 unknown, else 0 (never) to 5 (nearly always)."""
    if whole < least:
        return -1
    rate = part / whole
    return 0 if part == 0 else 1 + sum(rate > x for x in (0.01, 0.05, 0.3, 0.8))


class Stats:
    """Counts of tokens: dot and plain, ends and middles, starts and middles, attached and free."""

    def __init__(self, counts: dict[tuple[str, str], tuple[float, float]]):
        self.counts = counts

    def bin(self, kind: str, token: str) -> int:
        part, whole = self.counts.get((kind, _key(token)), (0, 0))
        return _bin(part, whole, 4 if kind.startswith("attach") else 2)


def _about_before(before: str, stats: Stats) -> tuple:
    shape = "num" + str(min(len(before), 4)) if before.isdigit() else "one" if len(before) == 1 else "dots" if "." in before else _class(before[:1] or "?")
    return shape, _script(before[-1:] or "?"), min(len(before), 8), stats.bin("dot", before), stats.bin("end", before)


def _about_after(after: str, raw: str, stats: Stats) -> tuple:
    return _class(raw) if raw in OPENERS or not after else _class(after), _class(after or raw), stats.bin("start", after)


def _attached(closed: bool, clause: str, after: str, stats: Stats) -> int:
    return max(stats.bin("attach", clause), stats.bin("attach1", after)) if closed else -2


def _lexical(before: str, after: str, nc: str) -> list[str]:
    return [f"p{_key(before)}", f"n{_key(after)}", f"P{_key(before)}{nc}"]


def _shaped(mark: str, closed: bool, fresh: bool, left: tuple, right: tuple, attach: int) -> list[str]:
    (shape, script, size, dot, end), (nc, ac, start) = left, right
    return [
        "bias", f"m{mark}", f"m{mark}{closed}{nc}", f"l{size}{mark}", f"s{shape}{nc}{ac}", f"c{script}{mark}", f"d{dot}{nc}", f"d{dot}s{start}", f"d{dot}e{end}{nc}",
        f"e{end}s{start}{mark == ' '}", f"a{attach}{nc}", f"a{attach}s{start}", f"s{start}{shape}", f"s{start}{nc}{mark}", f"f{fresh}{shape}{nc}",
    ]


def features(c: tuple, stats: Stats) -> list[str]:
    _, _, mark, closed, before, after, clause, raw, fresh = c
    right = _about_after(after, raw, stats)
    return _shaped(mark, closed, fresh, _about_before(before, stats), right, _attached(closed, clause, after, stats)) + _lexical(before, after, right[0])


class Scorer:
    """The model's score of a candidate. What depends on one token alone is worked out once for each token, up to a bound."""

    MOST = 1 << 18

    def __init__(self, stats: Stats, weights: np.ndarray):
        self.stats, self.weights, self.trained, self.known = stats, weights, bool(weights.any()), {}

    def _once(self, key: tuple, make):
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            found = self.known[key] = make()
        return found

    def _sum(self, names: list[str]) -> float:
        return float(self.weights[_codes(names)].sum())

    def score(self, mark: str, closed: bool, before: str, after: str, clause: str, raw: str, fresh: bool) -> float:
        if not self.trained:
            return 1.0 if mark in "!?。！？।؟" else -1.0
        left = self._once(("b", before), lambda: _about_before(before, self.stats))
        right = self._once(("a", after, raw), lambda: _about_after(after, raw, self.stats))
        attach = self._once(("c", clause, after), lambda: _attached(True, clause, after, self.stats)) if closed else -2
        lexical = self._once(("l", before, after, right[0]), lambda: self._sum(_lexical(before, after, right[0])))
        return lexical + self._once((mark, closed, fresh, left, right, attach), lambda: self._sum(_shaped(mark, closed, fresh, left, right, attach)))


def reliable(c: tuple, stats: Stats) -> int:
    """1 surely a boundary, 0 surely none, -1 not sure."""
    _, _, mark, closed, before, after, clause, raw, fresh = c
    dot, end, start = stats.bin("dot", before), stats.bin("end", before), stats.bin("start", after)
    if mark == " ":
        return 0 if start == 0 or end == 0 else 1 if start >= 3 and end >= 2 else -1
    if raw in ",;:，；、،؛—–)" or (mark not in WIDE and _class(after or raw) == "lower" and raw not in OPENERS):
        return 0
    if closed:
        if max(stats.bin("attach", clause), stats.bin("attach1", after)) == 5 and not raw.isupper():
            return 0
        return 1 if start >= 1 and (raw.isupper() or stats.bin("attach", clause) in (0, 1, 2, 3)) else -1
    if mark == ".":
        if before.endswith(")"):
            return 1 if start >= 1 else -1
        if len(before) == 1 and before.isupper() and (fresh or start <= 2) and after[:1].isupper():
            return 0
        if dot >= 5 and (end == 0 or start <= 0 and len(before) <= 6):
            return 0
        if before.isdigit() and len(before) <= 2 and (start == 0 or re.fullmatch(r"\d+\.", after)):
            return 0
        return 1 if start >= 2 and 0 <= dot <= 3 and len(before) > 2 else -1
    return 1 if mark in "!?。！？।؟．" and start != 0 else -1


def _codes(feats: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(f) % DIM for f in feats]


def _nested(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The outermost spans of brackets and quotations that are closed within the unit, in order."""
    inside, stack = [], []
    for m in BRACKET.finditer(text, a, b):
        ch = m[0]
        if stack and ch == stack[-1][1]:
            inside.append((stack.pop()[0], m.end()))
        elif ch in PAIRS:
            stack.append((m.start(), PAIRS[ch]))
    out: list[tuple[int, int]] = []
    for span in sorted(inside):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


PAIRS = {"“": "”", "«": "»", "(": ")", "（": "）", "「": "」", "『": "』", "《": "》", "„": "“", "[": "]", "【": "】"}
COUNTED = "kind string, token string, part double, whole double"
UNITS = "unit_at array<int>, unit_end array<int>, unit_first array<int>, unit_cuts array<int>"
CUTS = "cut_end array<int>, cut_start array<int>, signs array<string>, before array<string>, after array<string>, clause array<string>"


class _Counts:
    """What a batch adds to the statistics, by the tokens as they are written."""

    def __init__(self):
        self.sums: dict[tuple[str, str], list[float]] = {}
        self.inner, self.last = Counter(), Counter()

    def add(self, kind: str, token: str, part: bool, n: int = 1) -> None:
        if token:
            s = self.sums.setdefault((kind, token), [0.0, 0.0])
            s[0] += part * n
            s[1] += n

    def see(self, text: str, a: int, b: int, cs: list[tuple]) -> None:
        self.add("start", _after(text, a, b), True)
        k = b
        while k > a and (text[k - 1] in MARK_CHARS or text[k - 1] in CLOSE_CHARS or text[k - 1] == " "):
            k -= 1
        self.add("end", _before(text, a, k), True)
        free = [a]
        for c in cs:
            self.add("end", c[4], False)
            self.add("start", c[5], False)
            if c[3]:
                self.add("attach", c[6], True)
                self.add("attach1", c[5], True)
            elif c[2] != " ":
                free.append(c[1])
        for s in free:  # clauses that follow no closed quotation
            self.add("attach", _clause_end(text, s, b), False)
            self.add("attach1", _after(text, s, b), False)
        tokens = text[a:b].split(" ")
        self.inner.update(tokens[:-1])
        self.last[tokens[-1]] += 1

    def rows(self) -> list[tuple]:
        for counter, inner in ((self.inner, True), (self.last, False)):
            for token, n in counter.items():
                t = _bare(token)
                bare = t.rstrip(".")
                if 0 < len(bare) <= 12 and not is_wide(bare[0]):
                    self.add("dot", bare, inner and t.endswith("."), n)
        keyed: dict[tuple[str, str], list[float]] = {}
        for (kind, token), (part, whole) in self.sums.items():
            s = keyed.setdefault((kind, _key(token)), [0.0, 0.0])
            s[0] += part
            s[1] += whole
        return [(*k, *v) for k, v in keyed.items()]


def read(docs: DataFrame) -> DataFrame:
    """One pass over the texts: for each document its units and candidates, and for each batch (doc_id null) what it adds to the statistics.

    ``signs`` of a candidate are five characters: the mark, the next character, and whether it is closed, begins
    afresh, and stands outside all brackets and quotations.
    """
    names = [x.split(" ")[0] for x in f"doc_id long, {UNITS}, {CUTS}, {COUNTED}".split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, rows = _Counts(), []
            for doc_id, raw in zip(batch["doc_id"], batch["text"]):
                text = flat(raw)
                at, stop, first, cuts = [], [], [], []
                found: list[list] = [[], [], [], [], [], []]
                for a, b in units(raw):
                    item = ITEM.match(text, a, b)
                    cs = candidates(text, a, b)
                    counts.see(text, a, b, cs)
                    spans = _nested(text, a, b) if cs else []
                    for end, start, mark, closed, before, after, clause, nxt, fresh in cs:
                        i = bisect_left(spans, (end, 0)) - 1
                        free = i < 0 or spans[i][1] <= end
                        for column, x in zip(found, (end, start, f"{mark}{nxt}{closed:d}{fresh:d}{free:d}", before, after, clause)):
                            column.append(x)
                    at.append(a)
                    stop.append(b)
                    first.append(item.end() if item else a)
                    cuts.append(len(cs))
                if at:
                    rows.append((doc_id, at, stop, first, cuts, *found, None, None, None, None))
            rows += [(None, *[None] * 10, *r) for r in counts.rows()]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(scan, f"doc_id long, {UNITS}, {CUTS}, {COUNTED}")


def statistics(scanned: DataFrame) -> Stats:
    """The corpus counts of all tokens that make up at least one in ``VOCAB_ONE_IN`` of their kind: a bounded number."""
    observed = scanned.where("kind is not null").select("kind", "token", "part", "whole")
    sums = cut(observed.groupBy("kind", "token").agg(F.sum("part").alias("part"), F.sum("whole").alias("whole")))
    total = sums.groupBy("kind").agg(F.sum("whole").alias("total"))
    kept = sums.join(F.broadcast(total), "kind").where(F.col("whole") >= F.greatest(F.lit(2.0), F.col("total") / VOCAB_ONE_IN))
    return Stats({(r.kind, r.token): (r.part, r.whole) for r in kept.select("kind", "token", "part", "whole").collect()})


def train(docs: DataFrame, shared, rows: int = TRAIN) -> np.ndarray:
    """The weights, by gradient descent over at most ``rows`` reliable candidates; ``shared`` is the broadcast ``Stats``."""
    n_docs = max(1, docs.count())

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats = shared.value
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch["doc_id"], batch["text"]):
                parts, text = units(raw or ""), flat(raw or "")
                labelled = [(c, 1) for one, two in zip(parts, parts[1:]) if (c := junction(text, one, two))]
                labelled += [(c, y) for a, b in parts for c in candidates(text, a, b) if (y := reliable(c, stats)) >= 0]
                out += [(xxhash.xxh64_intdigest(f"{doc_id}.{c[0]}") >> 1, np.array(_codes(features(c, stats)), dtype=np.uint16).tobytes(), y) for c, y in labelled]
            yield pd.DataFrame(out, columns=["place", "codes", "y"])

    # documents by hash, so many that a few reliable candidates in each fill the bound; then exactly the bound by place
    share = min(1.0, rows / n_docs / DOC_HAS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = some.dropDuplicates(["doc_id"]).mapInPandas(label, "place long, codes binary, y int").orderBy("place").limit(rows).toPandas()
    weights = np.zeros(DIM)
    if sample.empty or sample["y"].nunique() < 2:
        return weights
    x = np.frombuffer(b"".join(sample["codes"]), dtype=np.uint16).astype(np.int64).reshape(len(sample), -1)
    y = sample["y"].to_numpy(dtype=float)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    square = np.full(DIM, 1e-8)
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1), -30, 30)))
        error = (p - y) * balance / len(y)
        grad = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), DIM) + PENALTY * weights / DIM
        square += grad**2
        weights -= 0.5 * grad / np.sqrt(square)
    return weights


def boundaries(row, scorer: Scorer) -> list[tuple[int, int]]:
    """The sentences of a document that ``read`` has scanned, as offsets in characters."""
    out, i = [], 0
    for a, b, first, n in zip(row.unit_at, row.unit_end, row.unit_first, row.unit_cuts):
        at = a
        for k in range(i, i + n):
            end, signs = row.cut_end[k], row.signs[k]
            mark, raw, closed, fresh, free = signs
            if end <= first or end < at or free == "0" or raw in ",;:，；、،؛" or mark != " " and raw in "—–)":
                continue
            if scorer.score(mark, closed == "1", row.before[k], row.after[k], row.clause[k], raw, fresh == "1") > 0:
                out.append((at, end))
                at = row.cut_start[k]
        i += n
        if b > at:
            out.append((at, b))
    return out


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, start_at, end_at) of every sentence."""
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    context = docs.sparkSession.sparkContext
    texts = texts.repartition(max(1, context.defaultParallelism * 2), "doc_id")
    scanned = cut(read(texts))
    shared = context.broadcast(statistics(scanned))
    weights = context.broadcast(train(docs.where("text is not null and doc_id is not null").select("doc_id", "text"), shared))

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value, weights.value)
        for batch in batches:
            rows = [(row.doc_id, s, e) for row in batch.itertuples(index=False) for s, e in boundaries(row, scorer)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_at", "end_at"])

    return scanned.where("doc_id is not null").drop("kind", "token", "part", "whole").mapInPandas(segment, "doc_id long, start_at long, end_at long")
