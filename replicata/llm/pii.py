"""Problem 8: personal data in free text, by bootstrapped contextual extraction.

Candidates of all kinds are found by shape, in one pass over the texts, and written with the patterns around them.  Some are seeds: their
shape or the lexicon leaves no doubt.  Seeds induce lexical patterns (the words before and after them); a graph of patterns and
instances is scored iteratively in Spark; patterns of high confidence then discover the candidates that nothing but their context gives
away: names, phones and identity numbers of weak shape, addresses without a known street word, mail addresses in unusual disguise.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replicata.plans.skew import join_per_key
from replicata.plans.storage import materialize, release, spread

# Shapes of identifiers, street words, titles.
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:@|[ ]@[ ]|[ ]?[\[({<][ ]?(?:at|AT|At|@)[ ]?[\])}>][ ]?)"
_DOT = r"(?:\.|[ ]?[\[({<][ ]?(?:dot|DOT|Dot|\.)[ ]?[\])}>][ ]?)"
_LOCAL = r"(?<![\w.+@-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}|[ ](?:at|AT)[ ]{_LABEL}(?:(?:\.|[ ](?:dot|DOT)[ ]){_LABEL})*[ ](?:dot|DOT)[ ][A-Za-z]{{2,24}})(?![\w-])")

# A weak disguise: words like these can also be an ordinary sentence.
_WEAK_EMAIL = re.compile(rf"{_LOCAL}(?:[ ](?:at|AT)[ ]|_(?:at|AT)_|-(?:at|AT)-){_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}}(?![\w-])")
_MARK = re.compile(r"@|[ \[({<_-][ ]?(?:at|AT|At|@)[ ]?[ \])}>_-]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

_UP = r"[^\W\d_a-zß-öø-ÿ]"
_UPS = "A-Z\u00c0-\u00de\u0100-\U0010ffff"  # all that can be _UP, as a plain range
_WORD_UP = rf"{_UP}[^\W\d_]*"
_STREET = r"(?:Ave\.?|Avenue|Road|Rd\.?|Blvd\.?|Boulevard|Ln\.?|Lane|Street|St\.?|Court|Ct\.?|Drive|Dr\.?|Way|Place|Pl\.?|Terrace|Square|Parkway|Highway)"
_TOWN = rf"{_WORD_UP}(?!\w)(?:[ -]{_WORD_UP}(?!\w))?"
_POSTCODE = r"(?:\d{5}(?!\d)|[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}(?!\w))"
_UNIT = r"(?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|No)\.?[ ]\d{1,5}[A-Za-z]?"
_GAP = r",?[ \n][ ]?"
ADDRESS = re.compile(
    rf"(?=[\d{_UPS}])(?<![\w/.-])(?:"
    rf"(?:{_UNIT},[ ])?\d{{1,5}}[A-Za-z]?[ ](?:(?:North|South|East|West|N\.|S\.|E\.|W\.)[ ])?(?:{_WORD_UP}[ ]){{1,2}}{_STREET}(?!\w)(?:,[ ]{_UNIT})?(?:(?:,[ ]|\n){_TOWN}(?:,?[ ]{_POSTCODE})?|,?[ ]{_POSTCODE})?"
    rf"|(?:P\.?[ ]?O\.?[ ]Box|PO[ ]Box|Postfach|B\.?P\.?|Apartado)[ ]\d{{1,6}}(?:(?:,[ ]|\n){_TOWN}(?:,?[ ]\d{{5}}(?!\d))?|(?:,[ ]|\n)\d{{5}}[ ]{_TOWN})?"
    rf"|{_UP}[^\W\d_]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)[ ]\d{{1,4}}[ ]?[a-z]?(?![\w])(?:(?:,[ ]|\n)(?:D-)?\d{{5}}[ ]{_TOWN})?"
    rf"|\d{{1,4}}(?:[ ](?:bis|ter|quater))?,?[ ](?:rue|avenue|place|boulevard|allée|chemin|quai|impasse|route|cours)[ ](?:(?:de[ ]la|de[ ]l'|des|du|de|d')[ ]?)?{_WORD_UP}(?:[ -]{_WORD_UP})?(?:(?:,[ ]|\n)\d{{5}}[ ]{_TOWN})?"
    rf"|(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino|Ronda)[ ](?:(?:de[ ]la|de[ ]los|del|de)[ ])?{_WORD_UP}(?:[ ]{_WORD_UP})?,?[ ]\d{{1,4}}(?!\d)(?:,[ ]\d{{1,2}}[.]?[ºª°][ ][A-Z](?!\w))?(?:(?:,[ ]|\n)(?:\d{{5}}[ ])?{_TOWN})?"
    rf")"
)
_PHONES = [
    # (shape, whether the shape alone is enough)
    (r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){1,5}(?:-\d{1,4})?", True),
    (r"00[1-9]\d{0,2}(?:[ ]\d{1,5}){2,5}(?:-\d{1,4})?", False),
    (r"(?:\+?1[ .-]?)?\(\d{3}\)[ ]?\d{3}[ .-]\d{4}", True),
    (r"1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}", False),
    (r"\d{3}[ .-]\d{3}[ .-]\d{4}", False),
    (r"0\d{2,4}[ /-]\d{3,8}(?:-\d{1,4})?", False),
    (r"0\d(?:[ .-]\d{2}){4}", False),
    (r"\d{3}[ .-]\d{2}[ .-]\d{4}", False),
    (r"\d{3}[ .-]\d{3}[ .-]\d{3}", False),
]
_EXT = r"(?:[ ]?(?:ext\.?|extension|x)[ ]?\d{1,6})?"
_END = r"(?![\w]|[-./,]\d)"
_LEFT = r"(?<![\w#@+])(?<![\w][-./,])(?<!\d[ ])"
_IDS = [
    (r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]", True),
    (r"[A-Z]{2}-\d{4}-\d{4}-\d", True),
    (r"\d{8}-?[A-Z]", True),
    (r"9\d{2}(?P<sep>[-. ])\d{2}(?P=sep)\d{4}", False),
    (r"[A-Z]\d{7,8}[A-Z]?", False),
    (r"\d{9}", False),
    (r"\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3}", False),
]
# Identity numbers go before phones of the same digits; the longest shape of a phone goes first.
_SHAPES = [("id_number", p, s) for p, s in _IDS[:4]] + [("phone", p + _EXT, s) for p, s in _PHONES] + [("id_number", p, s) for p, s in _IDS[4:]]
NUMBER = re.compile(rf"(?=[(+\dA-Z]){_LEFT}(?:" + "|".join(rf"(?P<n{i}>{p}){_END}" for i, (_, p, _) in enumerate(_SHAPES)) + ")")
TITLES = {"dr", "prof", "pr", "mr", "mrs", "ms", "mx", "miss", "herr", "frau", "monsieur", "madame", "mme", "mlle", "dra", "sr", "sra", "srta", "señor", "señora", "don", "doña"}

_NAMEPART = rf"(?:{_UP}[^\W\d_]+(?:['’-]{_UP}[^\W\d_]+)*)"
_RUN = re.compile(rf"(?<![\w@./-])(?:{_UP}\.(?=[ ]{_UP})|{_NAMEPART}(?![\w@/]|-\w))(?:,?[ ](?:{_UP}\.(?=[ ]{_UP})|{_NAMEPART}(?![\w@/]|-\w)))*")
# An address of which only the shape of number, words, post code and town is known: what may stand around a run of capitalised words.
_MORE = rf"(?:[ ][a-zß-öø-ÿ]{{1,5}}'?){{1,2}}[ ]?{_NAMEPART}(?:[ ]{_NAMEPART})?"
_HOUSE_AFTER = re.compile(rf"(?:{_MORE})?,?[ ]\d{{1,4}}[ ]?[A-Za-z]?(?![\w.])")
_WORDS_AFTER = re.compile(rf"(?:{_MORE})?(?!\w)")
_HOUSE_BEFORE = re.compile(rf"(?=\d)(?<![\w/.,-])(?<!\d[ ])\d{{1,4}}[A-Za-z]?,?[ ](?:[a-zß-öø-ÿ]{{2,10}}[ ]){{0,2}}(?={_UP})")
_TAIL = re.compile(rf"(?:,[ ]|\n|[ ])(?:(?:[A-Z]{{1,2}}-)?\d{{4,6}}[ ]{_TOWN}|{_TOWN},?[ ]{_POSTCODE})")
_PIECE = re.compile(rf"{_NAMEPART}|{_UP}\.|,")
_CONTEXT = re.compile(r"\n|[^\W\d_]+|\d+|[^\w\s]|\x01+|\x02+|\x03+|\x04+")
_MASK = {"email": "\x01", "phone": "\x02", "id_number": "\x03", "address": "\x04"}


def _is_text_caps(w: str) -> bool:
    return len(w) > 1 and w.isupper()


class Lexicon:
    """Known given and family names, without letter case; hyphenated names count when every part does."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.given = {t.casefold() for t, r in rows if t and r == "given"}
        self.family = {t.casefold() for t, r in rows if t and r == "family"}

        self._parts: dict[str, list[str]] = {}
        self._known: dict[str, bool] = {}

    def has(self, token: str, role: set[str]) -> bool:
        parts = self._parts.get(token)
        if parts is None:
            if len(self._parts) > 100_000:
                self._parts.clear()
            parts = self._parts[token] = [p.casefold() for p in re.split("['’-]", token)]
        return all(p in role for p in parts)

    def known(self, token: str) -> bool:
        """Whether a word is a given or a family name."""
        found = self._known.get(token)
        if found is None:
            if len(self._known) > 100_000:
                self._known.clear()
            found = self._known[token] = self.has(token, self.given) or self.has(token, self.family)
        return found

    def seed(self, form: str, parts: list[str]) -> bool:
        """Whether the lexicon alone shows a full name."""
        if form in ("WW", "WIW"):
            return self.has(parts[0], self.given) and self.has(parts[-1], self.family)
        if form == "W,W":
            return self.has(parts[0], self.family) and self.has(parts[-1], self.given)
        return form == "IW" and self.has(parts[-1], self.family)


_FORMS = ("WIW", "WW", "IW", "W,W", "W")


def _spans(run: re.Match) -> list[tuple[int, int, str, list[str]]]:
    """All names that a run of capitalised words can hold: ``(start, end, form, words)``."""
    if " " not in run[0]:
        return [(run.start(), run.end(), "W", [run[0]])] if len(run[0]) > 2 else []
    pieces = [(m.start(), m.end(), m[0]) for m in _PIECE.finditer(run.string, run.start(), run.end())]
    kinds = ["," if t == "," else "I" if t.endswith(".") else "W" for _, _, t in pieces]
    out = []
    for i in range(len(pieces)):
        for n in (3, 2, 1):
            form = "".join(kinds[i : i + n])
            if i + n <= len(pieces) and form in _FORMS and len(form) == n:
                out.append((pieces[i][0], pieces[i + n - 1][1], form, [t for _, _, t in pieces[i : i + n] if t != ","]))
    return out


class Context:
    """The tokens of a masked text, and the patterns before and after a place in it."""

    def __init__(self, text: str):
        found = list(_CONTEXT.finditer(text))
        self.text, self.toks, self.starts = text, [m[0] for m in found], [m.start() for m in found]

    @staticmethod
    def _shape(t: str | None) -> str:
        """A token by kind: numbers, masks and capitalised words lose their text."""
        if t is None:
            return "^"
        c = t[0]
        return "<n>" if c.isdigit() else f"<{ord(c)}>" if c < "\x05" else "⏎" if c == "\n" else "<C>" if c.isupper() else t

    @classmethod
    def _literal(cls, t: str | None) -> str:
        return t if t is not None and t[0].isalpha() else cls._shape(t)

    def left(self, start: int) -> tuple[str, str]:
        """The pattern before ``start``, and the word right before it alone (empty if there is none)."""
        i = bisect_left(self.starts, start)
        t1, t2, t3 = (*self.toks[max(0, i - 3) : i][::-1], None, None, None)[:3]
        near = self._literal(t1)
        if near == "⏎":
            return f"{self._literal(t3) if self._shape(t2) == ',' else '*'} {self._literal(t2)} ⏎", ""
        if near == ".":
            word = self._literal(t2)
            title = word + "." if len(word) <= 5 and word[0].isupper() and self.starts[i - 1] == self.starts[i - 2] + len(word) else ""
            return (f"{self._shape(t3)} {title}" if title else f"{self._shape(t2)} ."), title
        return f"{self._shape(t2)} {near}", near if near[0].isalpha() else ""

    def right(self, end: int) -> str:
        i = bisect_left(self.starts, end)
        t1, t2 = (*self.toks[i : i + 2], None, None)[:2]
        return f"{self._literal(t1)} {self._shape(t2)}"


class Candidate:
    __slots__ = ("end", "form", "kind", "seed", "start", "value")

    def __init__(self, kind: str, start: int, end: int, value: str, seed: bool, form: str = ""):
        self.kind, self.start, self.end, self.value, self.seed, self.form = kind, start, end, value, seed, form


def _emails(text: str) -> list[Candidate]:
    """Mail addresses, looked for only around what can stand for the sign between their halves."""
    out: list[Candidate] = []
    done = 0
    for mark in _MARK.finditer(text):
        at = mark.start()
        if at < done:
            continue
        while at > done and text[at - 1] in " [({<":
            at -= 1
        first = at
        while first > done and text[first - 1] in _LOCAL_CHARS:
            first -= 1
        m = next((m for s in range(first, at) if (m := EMAIL.match(text, s))), None)
        weak = None if m else next((m for s in range(first, at + 1) if (m := _WEAK_EMAIL.match(text, s))), None)
        if m or weak:
            m = m or weak
            out.append(Candidate("email", *m.span(), m[0], weak is None))
            done = m.end()
    return out


def shaped(text: str) -> tuple[list[Candidate], str]:
    """E-mail addresses, postal addresses, phone and identity numbers by shape, in this order, and the text with them masked.

    What may be a sentence as well as a disguised e-mail address comes out but is not masked.
    """
    out: list[Candidate] = []

    def mask(text: str, found: list[Candidate]) -> str:
        parts, at = [], 0
        for c in found:
            parts += [text[at : c.start], _MASK[c.kind] * (c.end - c.start)]
            at = c.end
        return "".join([*parts, text[at:]]) if found else text

    out = _emails(text)
    masked = mask(text, [c for c in out if c.seed])
    found = [Candidate("address", *m.span(), m[0], True) for m in ADDRESS.finditer(masked)]
    masked, out = mask(masked, found), out + found
    found = []
    for m in NUMBER.finditer(masked):
        group = m.lastgroup if m.lastgroup != "sep" else "n3"
        kind, _, strong = _SHAPES[int(group[1:])]
        if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 21:
            continue
        found.append(Candidate(kind, *m.span(), m[0], strong or "ext" in m[0]))
    return out + found, mask(masked, found)


def _address_around(masked: str, s: int, e: int, houses: dict[int, int]) -> Candidate | None:
    """The address without a known street word that a run of capitalised words can be part of: a number beside it, and as far as written post code and town.

    ``houses``: where numbers begin that stand before capitalised words, by where those begin.  ``form``: ``T`` with post code and town, else ``N``.
    """
    after = _HOUSE_AFTER.match(masked, e) if masked[e : e + 1] in (" ", ",") else None
    if after:
        e = after.end()
    elif s in houses:
        words = _WORDS_AFTER.match(masked, e)
        s, e = houses[s], words.end() if words else e
    else:
        return None
    tail = _TAIL.match(masked, e)
    if tail:
        e = tail.end()
    return Candidate("address", s, e, masked[s:e], False, "T" if tail else "N")


def named(masked: str, lexicon: Lexicon) -> tuple[list[tuple], list[Candidate]]:
    """Names that the runs of capitalised words in a masked text can hold, as ``(start, end, value, seed, form, outer)``, and addresses without a
    known street word around them.

    ``outer``: 1 for the longest name at its start, whose left pattern counts, plus 2 for the longest at its end, whose right pattern counts.
    """
    out, places, done = [], [], 0
    houses = {m.end(): m.start() for m in _HOUSE_BEFORE.finditer(masked)}
    for run in _RUN.finditer(masked):
        s, e = run.span()
        text = run[0]
        if " " not in text:
            if len(text) > 2 and text.casefold() not in TITLES:
                out.append((s, e, text, False, "W", 3))
        else:
            spans = [x for x in _spans(run) if x[3][0].casefold() not in TITLES]
            longest, earliest = {}, {}
            for a, z, *_ in spans:
                longest[a], earliest[z] = max(z, longest.get(a, z)), min(a, earliest.get(z, a))
            out += [(a, z, masked[a:z], form != "W" and lexicon.seed(form, words), form, (longest[a] == z) + 2 * (earliest[z] == a)) for a, z, form, words in spans]
        if s >= done and (place := _address_around(masked, s, e, houses)):
            places.append(place)
            done = place.end
    return out, places


def is_title(word: str) -> bool:
    return word.rstrip(".").casefold() in TITLES


_CANDIDATES = "uid bigint, doc_id bigint, kind string, start int, end int, value string, seed boolean, form string, left string, near string, right string, title boolean, known boolean, outer int"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()]


def candidates_of(text: str, lexicon: Lexicon) -> list[tuple]:
    """Everything in a text that may be personal data: the columns of ``_CANDIDATES`` from ``kind`` on."""
    found, masked = shaped(text)
    names, places = named(masked, lexicon)
    at = Context(masked)
    out = [(c.kind, c.start, c.end, c.value, c.seed, c.form, at.left(c.start)[0], None, at.right(c.end), False, False, 3) for c in [*found, *places]]
    last, pattern, title = -1, ("", ""), False
    for start, end, value, seed, form, outer in names:
        if start != last:
            last, pattern = start, at.left(start)
            title = is_title(pattern[1])
        out.append(("name", start, end, value, seed, form, pattern[0], pattern[1] or None, at.right(end), title, lexicon.known(value.partition(" ")[0]), outer))
    return out


def candidates(docs: DataFrame, lexicon: Lexicon, texts: bool = False) -> DataFrame:
    """One row per candidate of every document, in one pass over the texts; ``uid`` tells the documents' rows apart, also repeated ones.

    With ``texts`` one row more per document, of kind ``text``, holds its text, also where that is null or empty.
    """
    given, family = sorted(lexicon.given), sorted(lexicon.family)
    # Plain values only: a broadcast is pickled by reference, and executors need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast([(t, "given") for t in given] + [(t, "family") for t in family])
    names = [x.split()[0] for x in _CANDIDATES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, known = TaskContext.get().partitionId() << 40, Lexicon(shared.value)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                uid += 1
                if texts:
                    rows.append((uid, doc, "text", 0, 0, text, *[None] * 7, 0))
                if text:
                    rows += [(uid, doc, *c) for c in candidates_of(text, known)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(source if texts else source.filter("text is not null and text <> ''")).mapInArrow(run, _CANDIDATES)


def pattern_graph(found: DataFrame) -> DataFrame:
    """Edges between patterns and instances over the whole corpus: ``kind, pattern, instance, seed, n``.

    Patterns are summed before the shuffle.  They belong to a kind, and candidates of weak shape speak against those around them.
    """
    edge = lambda code, c, on: F.when(on & F.col(c).isNotNull(), F.concat(F.lit(code), F.col(c)))
    left, right = F.col("outer").bitwiseAND(1) > 0, F.col("outer").bitwiseAND(2) > 0
    patterns = F.array_compact(F.array(edge("L ", "left", left), edge("W ", "near", left), edge("R ", "right", right)))
    instance = F.when(F.col("kind") == "name", F.lower("value")).otherwise(F.col("value"))
    edges = found.filter("kind <> 'text' and outer > 0").select("kind", F.explode(patterns).alias("pattern"), instance.alias("instance"), (F.col("seed") | F.col("title")).alias("seed"))
    return edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def score_patterns(graph: DataFrame, rounds: int = 3, least_instances: int = 3, least_mentions: int = 100, damping: float = 0.8) -> DataFrame:
    """``kind, pattern, score, support, seeds, n``: the mean score of a pattern's instances or of its mentions, whichever is less.

    A seed scores 1.  In each round an instance that is none gets the damped mean of its patterns' scores, and patterns are scored anew.
    Patterns with fewer than ``least_instances`` distinct instances and ``least_mentions`` mentions speak neither for nor against anything.
    """
    edges = materialize(graph)
    scores = edges.withColumn("s", F.col("seed").cast("double"))
    old = None

    def patterns(scores: DataFrame) -> DataFrame:
        by = scores.groupBy("kind", "pattern").agg(F.least(F.avg("s"), F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("score"), F.count("*").alias("support"), F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum("n").alias("n"))
        return by.filter((F.col("support") >= least_instances) | (F.col("n") >= least_mentions))

    for _ in range(rounds):
        heard = scores.join(patterns(scores).select("kind", "pattern", "score"), ["kind", "pattern"])
        instances = heard.groupBy("kind", "instance").agg((F.lit(damping) * F.avg("score")).alias("i"))
        nxt = materialize(scores.drop("s").join(instances, ["kind", "instance"], "left").withColumn("s", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("i", F.lit(0.0)))).drop("i"))
        release(old)
        scores = old = nxt
    return patterns(scores)


def decide(found: DataFrame, scored: DataFrame, accept: float, reject: float, sure: float = 0.6) -> DataFrame:
    """The candidates that their shape or a pattern shows to be personal data, with ``firm``: a seed, or behind a title.

    A name needs a seed, a title before it or a pattern of confidence ``accept``; a pattern below ``reject`` on the other side
    speaks against it, but not against one of confidence ``sure``.  A number of weak shape needs one such pattern.  An address without a known street
    word needs a left pattern of confidence ``accept`` with post code and town, else ``sure``, a mail address in weak disguise ``sure``, and none against them.  A
    word that itself stands before names is no part of them unless the lexicon has it.

    Scores come by joins on the patterns, however many there are; a pattern around very many candidates is dealt to several tasks.
    """
    useful = materialize(scored.filter((F.col("score") >= accept) & (F.col("seeds") >= 2) | (F.col("score") < reject)))
    of = lambda code: useful.filter(F.col("pattern").startswith(code)).withColumn("pattern", F.substr("pattern", F.lit(3)))

    def joined(rows: DataFrame, code: str, place: str, score: str) -> DataFrame:
        return join_per_key(rows, of(code).select("kind", F.col("pattern").alias(place), F.col("score").alias(score), "n"), ["kind", place], "n", how="left")

    leads = of("W ").filter("kind = 'name' and score >= 0.8 and seeds >= 10").select("kind", F.col("pattern").alias("lead"), F.lit(True).alias("is_lead"), "n")
    # Candidates without a word before them match nothing; they are spread so that they don't all meet in one task.
    nothing = F.concat(F.lit("\0"), F.pmod("uid", F.lit(1000)).cast("string"))
    rows = found.filter("kind <> 'text'").withColumn("near", F.coalesce("near", nothing)).withColumn("lead", F.split_part("value", F.lit(" "), F.lit(1)))
    low = lambda c: F.coalesce(c, F.lit(-1.0))
    left = F.when(low(F.col("sl")) < accept, F.greatest(low(F.col("sl")), low(F.col("sn")))).otherwise(F.col("sl"))
    rows = joined(joined(rows, "L ", "left", "sl"), "W ", "near", "sn").withColumn("l", left).drop("left", "near", "sl", "sn")
    # Single capitalised words stand everywhere; without a title or a left pattern they are no names, whatever follows.
    rows = rows.filter((F.col("kind") != "name") | (F.col("form") != "W") | F.col("title") | (F.col("l") >= accept))
    rows = join_per_key(joined(rows, "R ", "right", "sr"), leads, ["kind", "lead"], "n", how="left")
    rows = rows.withColumn("r", low(F.col("sr"))).withColumn("best", F.greatest("l", "r"))
    l, r, best, seed, title, form, kind = (F.col(c) for c in ("l", "r", "best", "seed", "title", "form", "kind"))  # noqa: E741
    against = (r >= 0) & (r < reject)
    lacks = ((l >= 0) & (l < reject)) | against
    single = title | ((l >= accept) & ~lacks)
    several = (best >= sure) | ((seed | title | (best >= accept)) & (~lacks | (seed & (best >= accept))))
    name = ~(F.coalesce("is_lead", F.lit(False)) & ~F.col("known")) & F.when(form == "W", single).otherwise(several)
    loose = (l >= F.when(form == "T", accept).otherwise(sure)) & ~against
    ok = F.when(kind == "name", name).when(seed, True).when(kind.isin("address", "email"), loose).otherwise(best >= accept)
    return rows.filter(ok).select("uid", "doc_id", "kind", "start", "end", "value", (seed | title).alias("firm"), seed.alias("seed"))


class Kept:
    """Stretches of a text that don't overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Whether the stretch overlaps none so far; then it is added."""
        at = bisect_right(self.starts, start)
        if (at and self.ends[at - 1] > start) or (at < len(self.starts) and self.starts[at] < end):
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def resolve(found: list[dict]) -> list[dict]:
    """Of the accepted candidates of one text those that stay: shapes without doubt, then addresses and disguised mail, then the rest; of overlapping ones the longest."""
    rank = lambda c: (0 if c["seed"] and c["kind"] != "name" else 1 if c["kind"] in ("address", "email") else 2 if c["kind"] != "name" else 3, c["start"] - c["end"], not c["firm"], c["start"])
    kept = Kept()
    return sorted((c for c in sorted(found, key=rank) if kept.add(c["start"], c["end"])), key=lambda c: c["start"])


def redact(text: str, found: list[dict]) -> str:
    """``text`` with every value replaced by a placeholder of its kind."""
    parts, at = [], 0
    for c in found:
        parts += [text[at : c["start"]], f"<{c['kind'].upper()}>"]
        at = c["end"]
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, lexicon: DataFrame, accept: float = 0.3, reject: float = 0.05, most_names: int = 1_000_000, redacted: bool = False) -> DataFrame:
    """Personal data in texts: ``doc_id, kind, pii_value`` once per distinct value; with ``redacted`` instead ``doc_id, text`` with placeholders.

    Null and empty texts have none (redacted: they stay as they are).  Whole texts are read, once: their candidates are written with the patterns
    around them, patterns are scored over all of the corpus, and candidates meet their scores by joins.  Only the accepted candidates
    of a text, never more than it has words, come together in one row.  ``most_names`` bounds the lexicon that every task gets; beyond it the call fails.
    """
    names = lexicon.filter("token is not null").select("token", "role").limit(most_names + 1).collect()
    if len(names) > most_names:
        raise ValueError(f"the lexicon exceeds its bound of {most_names} names")
    found = materialize(candidates(docs, Lexicon([(r.token, r.role) for r in names]), texts=redacted))
    scored = materialize(score_patterns(pattern_graph(found)))
    accepted = decide(found, scored, accept, reject).groupBy("uid", "doc_id").agg(F.collect_list(F.struct("kind", "start", "end", "value", "firm", "seed")).alias("found"))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, c["kind"], c["value"]) for d, f in zip(b.column("doc_id").to_pylist(), b.column("found").to_pylist(), strict=True) for c in resolve(f)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "kind", "pii_value"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [redact(t, resolve(f)) if t and f else t for t, f in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    if redacted:
        whole = found.filter("kind = 'text'").select("uid", "doc_id", F.col("value").alias("text"))
        return whole.join(accepted.drop("doc_id"), "uid", "left").select("doc_id", "text", "found").mapInArrow(texts, "doc_id bigint, text string")
    return accepted.select("doc_id", "found").mapInArrow(values, "doc_id bigint, kind string, pii_value string").distinct()
