"""Mapping free-entered values to a canonical list: a trie of reference phrases searched with an edit automaton.

The phrases of an entry (label, label_zh, aliases) are paths of the trie, in their own and in sorted word order.
Alias paths are derived from them: the parts that a phrase lists, each alone and two in either order; what is left of
a phrase's sound without its ending, so that languages that spell a word apart meet; initials. Further alias paths
come from ``groups`` of names of one subject, by default the words of the catalogue's own tagging rules; the queries
add the terms that it keeps for the areas of the rating list (``area_groups``). A group belongs to the entry that has
most of its names (two at least if its first name lists several subjects), a name to the first group that has it. What
another vocabulary holds for an entry of its own is a group too. No other knowledge of subjects is built in: a name that
shares nothing with its entry's phrases is ``unmatched`` unless a group gives it. A value of several words that nothing
is near to means the entry in whose names alone all its words stand.

The automaton's state is the row of edit distances (insertion, deletion, substitution, transposition) of the value
against the path walked so far, kept within the distance allowed for the value's length; a branch is left as soon
as no continuation can stay within it. All entries within that distance are returned; the nearest is the match, ties
going to the list's own phrases, then to the smaller entry_id. Words cut short may end anywhere in the word of a path.
A value that lists several things means the entry that all of them name, or that one names if the others name none.

Distinct values are mapped once, whatever their number of rows. Null and blank values have no row; values
without a letter or digit, and those that nothing is near to, are ``unmatched``. An empty list leaves all
values unmatched. Repeated elements of a record count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import AREA_TERMS, SUBJECT_RULES, TAXONOMY
from ..session import cut, lookup

UNMATCHED = "unmatched"
#: entries searched in one pass; a longer list is searched in several passes
SHARD = 20_000
#: (length of the compact value, distance allowed from that length on)
ALLOWED = ((0, 0), (4, 1), (8, 2), (16, 3))
#: ranks of the paths, and what the derived ones add to the distance
OWN, ALIAS, PART, GROUP = 0, 1, 2, 3
#: fixed values: words around a value that say nothing about it, in general use
LEADING = ("mainly", "mostly", "especially", "esp", "chiefly", "the field of", "field of", "area of", "topics in")
TRAILING = ("etc", "and others", "and related areas", "research", "领域", "研究", "学科")
SMALL_WORDS = ("and", "of", "the", "in", "for", "und", "et", "y", "de")
#: what joins the things that a phrase lists
JOINTS = re.compile(r"[,;/&、，；]|\b(?:and|und|et|y)\b|[与和及]")
#: fixed values: spellings of one sound, in this order, and endings that say nothing of the subject
SOUNDS = (("ph", "f"), ("sch", "s"), ("ck", "k"), ("qu", "k"), ("c", "k"), ("q", "k"), ("y", "i"), ("z", "s"))
ENDINGS = re.compile(r"(?:iks?|ike|ings?|ers?|es|e|s)$")


def default_groups() -> list[tuple[str, ...]]:
    """The names that the catalogue's tagging rules hold for one subject."""
    rules = dict(SUBJECT_RULES)
    return [(tag, *names, *rules.get(tag, ())) for tag, names in TAXONOMY.items()]


def area_groups() -> list[tuple[str, ...]]:
    """The tagging rules' groups and the terms of each area of the rating list; a term that stands in a term of another area tells nothing."""

    def shared(title: str, term: str) -> bool:
        return any(set(words(term)) <= set(words(t)) for other, ts in AREA_TERMS.items() if other != title for t in ts)

    return default_groups() + [(title, *(t for t in ts if not shared(title, t))) for title, ts in AREA_TERMS.items()]


def words(text: str) -> list[str]:
    """Letters and digits, lower case, split at all else; dotted initials (A.I.) are one word."""
    text = re.sub(r"\b(\w)\.(?=\w\b)", r"\1", text.casefold().replace("’", "'"))
    return re.findall(r"[^\W_]+", text)


def _compact(ws: list[str]) -> str:
    return "".join(ws)


def _ordered(ws: list[str]) -> str:
    return "".join(sorted(w for w in ws if w not in SMALL_WORDS))


def _sound(ws: list[str]) -> str:
    """How the words sound, without the last one's ending; nothing if too little is left to tell them by."""
    text = unicodedata.normalize("NFKD", "".join(w for w in ws if w not in SMALL_WORDS))
    text = "".join(c for c in text if not unicodedata.combining(c))
    for spelling, sound in SOUNDS:
        text = text.replace(spelling, sound)
    text = ENDINGS.sub("", text)
    return text if len(text) >= 5 else ""


def _initials(ws: list[str]) -> str:
    ws = [w for w in ws if w not in SMALL_WORDS]
    return "".join(w[0] for w in ws) if len(ws) > 1 else ws[0] if ws and len(ws[0]) == 2 else ""


def _listed(phrase: str) -> list[str]:
    """The things that a phrase lists, if they are several."""
    found = [x.strip() for x in JOINTS.split(phrase) if x.strip()]
    return found if len(found) > 1 else []


def _derived(phrase: str) -> list[str]:
    """The things that a phrase lists, also with the last one's noun, and what stands before an ``of``."""
    listed = _listed(phrase)
    noun = words(listed[-1])[-1:] if listed else []
    shared = [" ".join([*words(x), *noun]) for x in listed[:-1] if noun and noun != words(x)[-1:]]
    return [*listed, *shared, *(x.split(" of ")[0] for x in (phrase, *listed) if " of " in x)]


def allowed(text: str) -> int:
    return max(d for least, d in ALLOWED if len(text) >= least)


class Trie:
    """Nodes are dicts from a character to a node; the key '' holds {entry_id: rank of the best phrase ending here}."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: str, rank: int) -> None:
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        ends = node.setdefault("", {})
        ends[entry] = min(rank, ends.get(entry, rank))

    def search(self, text: str, limit: int, begun: bool = False) -> list[tuple[int, int, str]]:
        """(distance, rank, entry) of every entry with a path within ``limit`` edits of ``text``; of a row only the places within ``limit`` of the diagonal are kept. ``begun``: paths that go on are met too."""
        found: list[tuple[int, int, str]] = []
        n, far = len(text), limit + 1
        first = [j if j <= limit else far for j in range(n + 1)]
        stack = [(node, c, 1, first, None, "") for c, node in self.root.items() if c]
        while stack:
            node, c, depth, above, above2, before = stack.pop()
            row = [far] * (n + 1)
            low, high, best = max(0, depth - limit), min(n, depth + limit), far
            for j in range(low, high + 1):
                if j == 0:
                    d = depth
                else:
                    d = above[j - 1] + (text[j - 1] != c)
                    if row[j - 1] < d:
                        d = min(d, row[j - 1] + 1)
                    if above[j] < d:
                        d = min(d, above[j] + 1)
                    if above2 is not None and j > 1 and text[j - 1] == before and text[j - 2] == c:
                        d = min(d, above2[j - 2] + 1)
                if d <= limit:
                    row[j] = d
                    if d < best:
                        best = d
            if row[n] <= limit:
                found += [(row[n], rank, e) for end in (self._ends(node) if begun else [node] if "" in node else []) for e, rank in end[""].items()]
            if best <= limit or min(above[max(0, low - 1) : high + 1], default=far) <= limit - 1:
                stack += [(child, k, depth + 1, row, above, c) for k, child in node.items() if k]
        return found

    def search_cut(self, parts: list[str]) -> list[tuple[int, int, str]]:
        """Entries with a path of as many words as ``parts`` (paths with spaces), each word beginning with its part."""
        nodes = [self.root]
        for i, part in enumerate(parts):
            nodes = [n for n in nodes for n in [self._walk(n, part)] if n is not None]
            ends, stack = [], nodes
            while stack:
                node = stack.pop()
                ends += [node] if i == len(parts) - 1 and "" in node else []
                ends += [node[" "]] if i < len(parts) - 1 and " " in node else []
                stack.extend(child for c, child in node.items() if c and c != " ")
            nodes = ends
        return [(1, rank, e) for node in nodes for e, rank in node[""].items()]

    @staticmethod
    def _ends(node: dict) -> list[dict]:
        ends, stack = [], [node]
        while stack:
            at = stack.pop()
            ends += [at] if "" in at else []
            stack.extend(child for c, child in at.items() if c)
        return ends

    @staticmethod
    def _walk(node: dict, part: str) -> dict | None:
        for c in part:
            if c not in node:
                return None
            node = node[c]
        return node


class Matcher:
    """The tries of one vocabulary: compact paths, paths by sound, and paths with spaces for words that are cut short."""

    def __init__(self, entries: list[tuple[str, str, str, list[str]]], groups: list[tuple[str, ...]] | None = None):
        self.near, self.sound, self.cut, self.initials = Trie(), Trie(), Trie(), {}
        self.told: tuple[dict[str, set[str]], dict[str, set[str]]] = {}, {}  # the entries whose own names, or whose groups', have a word
        named: dict[str, set[str]] = {}
        groups = default_groups() if groups is None else groups
        for entry, label, zh, aliases in entries:
            phrases = {p: OWN for p in (label, zh) if p} | {a: ALIAS for a in aliases or () if a}
            listed = list(dict.fromkeys(x for p in phrases for x in _listed(p)))
            named[entry] = {_compact(words(p)) for p in (*phrases, *listed)} | {_sound(words(p)) for p in (*phrases, *listed)} - {""}
            for phrase, rank in phrases.items():
                self._add(words(phrase), entry, rank)
            for one in dict.fromkeys(x for p in phrases for x in _derived(p)):
                self._add(words(one), entry, PART)
            for one in listed:
                for two in listed:
                    if two != one:
                        self._add(words(one) + words(two), entry, PART)
            short = list(dict.fromkeys(x for x in (_initials(words(p)) for p in (*phrases, *listed)) if len(x) > 1))
            for x in [*short, *(x + y for x in short for y in short if x != y)]:
                self.initials.setdefault(x, set()).add(entry)
        given: dict[str, set[str]] = {}
        for group in groups:
            shares = {e: sum(_compact(words(g)) in names or _sound(words(g)) in names for g in dict.fromkeys((*group, *_listed(group[0])))) for e, names in named.items()}
            least = 2 if _listed(group[0]) else 1  # what lists several subjects is wider than an entry that is one of them
            meant = {e for e, n in shares.items() if n >= least and n == max(shares.values())}
            for name in group if meant else ():
                for entry in given.setdefault(_compact(words(name)), meant) & meant:  # a name is its first group's
                    self._add(words(name), entry, GROUP)

    def _add(self, ws: list[str], entry: str, rank: int) -> None:
        if not ws:
            return
        for path in {_compact(ws), _ordered(ws), _compact([w for w in ws if w not in SMALL_WORDS])}:
            self.near.add(path, entry, rank)
        if sound := _sound(ws):
            self.sound.add(sound, entry, rank)
        for w in ws:
            self.told[rank == GROUP].setdefault(_sound([w]) or w, set()).add(entry)
        self.cut.add(" ".join(w for w in ws if w not in SMALL_WORDS), entry, rank)

    @staticmethod
    def readings(value: str) -> list[str]:
        """The value, and what is left without surrounding words, or on either side of brackets."""
        whole = value.strip()
        out = [whole]
        if inner := re.search(r"^(.*?)[(（\[](.+?)[)）\]]\s*$", whole):
            out += [inner[1], inner[2]]
        for text in list(out):
            t = text.strip(" .?!,;:#…")
            for lead in LEADING:
                if t.casefold().startswith(lead + " "):
                    t = t[len(lead) + 1 :]
            for trail in TRAILING:
                if len(t) > len(trail) and t.casefold().rstrip(". ").endswith(trail if ord(trail[0]) > 0x2E80 else " " + trail):
                    t = t.rstrip(". ")[: -len(trail)]
            out.append(t)
        return [t for t in dict.fromkeys(out) if t.strip()]

    def _near(self, text: str) -> list[tuple[int, int, str]]:
        ws = words(text)
        found: list[tuple[int, int, str]] = []
        for path in {_compact(ws), _ordered(ws), _compact([w for w in ws if w not in SMALL_WORDS])} - {""}:
            found += self.near.search(path, allowed(path))
        found += [(1, PART, e) for e in self.initials.get(_compact(ws), ())]
        if 2 < len(short := _initials(ws)) < 6:  # a phrase of the list may be the value's initials
            found += [(1 + d, rank, e) for d, rank, e in self.near.search(short, 0) if rank <= ALIAS]
        if sound := _sound(ws):
            found += [(1 + d, rank, e) for d, rank, e in self.sound.search(sound, min(1, allowed(sound) - 1))]
        if not found:
            dotted = [w for w in re.split(r"[\s\-/&,;_]+", text.casefold()) if w and w not in SMALL_WORDS]
            bare = [w.rstrip(".") for w in dotted]
            least = 2 if any(w.endswith(".") for w in dotted) else 3 if len(bare) > 1 else 6
            if dotted and dotted[-1].endswith(".") and len(_compact(bare)) >= 10:
                found += [(1 + d, rank, e) for d, rank, e in self.near.search(_compact(words(text)), allowed(_compact(bare)) - 1, begun=True)]
            if bare and all(len(w) >= least for w in bare):
                found += self.cut.search_cut(bare) or self.cut.search_cut([w[:-1] if w.endswith("s") and len(w) > 3 else w for w in bare])
        return found

    def all_near(self, value: str) -> tuple[tuple[int, int, str], ...]:
        """(distance, rank, entry) of every entry that the value may mean, the nearest first."""
        found: list[tuple[int, int, str]] = []
        texts = self.readings(value)
        for text in texts:
            found += self._near(text)
        if not found:
            for text in texts:
                each = [{e for _, _, e in self._near(x)} for x in _listed(text)]
                some = [es for es in each if es]
                found += [(2 + len(each) - len(some), PART, e) for e in (set.intersection(*some) if some else ())]
        if not found:
            for text in texts:  # words that only stand together in the names of one entry
                ws = [w for w in words(text) if w not in SMALL_WORDS]
                told = set.intersection(*(self.told[0].get(x) or self.told[1].get(x, set()) for x in (_sound([w]) or w for w in ws))) if len(ws) > 1 else set()
                found += [(3, GROUP, e) for e in told if len(told) == 1]
        best: dict[str, tuple[int, int, str]] = {}
        for hit in found:
            best[hit[2]] = min(hit, best.get(hit[2], hit))
        return tuple(sorted(best.values()))


def _search_udf(entries: list[tuple[str, str, str, str, list[str]]], groups: list[tuple[str, ...]] | None):
    shared: dict[str, Matcher] = {}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for vocab in {e[1] for e in entries}:
            # what another vocabulary holds for one of its entries is a group too
            others = [tuple(x for x in (e[2], e[3], *(e[4] or ())) if x) for e in entries if e[1] != vocab]
            own = default_groups() if groups is None else groups
            shared.setdefault(vocab, Matcher([(e[0], *e[2:]) for e in entries if e[1] == vocab], [*own, *(g for g in others if g)]))
        for batch in batches:
            hits = [
                (vocab, value, *hit)
                for vocab, value in zip(batch["vocab"], batch["raw_value"])
                for hit in (shared[vocab].all_near(value) if vocab in shared else ())
            ]
            yield pd.DataFrame(hits, columns=["vocab", "raw_value", "distance", "rank", "entry_id"])

    return search


def candidates(values: DataFrame, area_list: DataFrame, groups: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(vocab, raw_value, distance, rank, entry_id): all entries near to each distinct (vocab, raw_value)."""
    columns = ["entry_id", "vocab", "label", "label_zh", "aliases"]
    numbered = area_list.select(*columns).dropDuplicates(["entry_id"])
    shards = max(1, -(-numbered.count() // SHARD))
    out = None
    for k in range(shards):  # each pass sends at most about SHARD entries to the tasks
        part = numbered.where(F.pmod(F.xxhash64("entry_id"), F.lit(shards)) == k)
        entries = [(r.entry_id, r.vocab, r.label, r.label_zh, list(r.aliases or ())) for r in part.collect()]
        hits = values.mapInPandas(_search_udf(entries, groups), "vocab string, raw_value string, distance int, rank int, entry_id string")
        out = hits if out is None else out.unionByName(hits)
    return out


def elements(venues: DataFrame, profiles: DataFrame) -> DataFrame:
    """(field_name, rec_id, raw_value, vocab): the distinct non-blank elements of each record."""

    def field(df: DataFrame, name: str, rec: str, vocab: str) -> DataFrame:
        kept = F.filter(F.array_distinct(name), lambda x: x.isNotNull() & x.rlike(r"[^\s\p{Z}]"))
        return df.select(F.lit(name).alias("field_name"), F.col(rec).alias("rec_id"), F.explode(kept).alias("raw_value"), F.lit(vocab).alias("vocab"))

    return (
        field(venues, "subject_tags", "pos", "tag")
        .unionByName(field(profiles, "research_area", "profile_id", "area"))
        .unionByName(field(profiles, "ccf_research_area", "profile_id", "area"))
    )


def map_values(typed: DataFrame, area_list: DataFrame, groups: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Adds entry_id (or ``unmatched``) and distance to (…, raw_value, vocab), leaving out exact labels."""
    labels = F.broadcast(area_list.select("vocab", F.col("label").alias("raw_value")).distinct()) if area_list.count() <= SHARD else area_list.select("vocab", F.col("label").alias("raw_value")).distinct()
    open_values = typed.join(labels, ["vocab", "raw_value"], "left_anti")
    counts = cut(open_values.groupBy("vocab", "raw_value").agg(F.count(F.lit(1)).alias("n")))
    spread = counts.select("vocab", "raw_value").repartition(counts.sparkSession.sparkContext.defaultParallelism * 2)
    best = candidates(spread, area_list, groups).groupBy("vocab", "raw_value").agg(F.min(F.struct("distance", "rank", "entry_id")).alias("b"))
    found = cut(
        counts.join(best, ["vocab", "raw_value"], "left").select(
            "vocab", "raw_value", "n", F.coalesce("b.entry_id", F.lit(UNMATCHED)).alias("entry_id"), F.col("b.distance").alias("distance")
        )
    )
    total = found.agg(F.sum("n")).first()[0] or 0
    return lookup(open_values, found, ["vocab", "raw_value"], "n", total)
