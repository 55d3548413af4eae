"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers are composed, each reading what the one before writes. The *lexicon* reads words and
writes symbols (insult, threat, modal, target, negation, report, or none), with the word's weight. The
*scopes* read symbols and write them marked as negated, reported or neither: negation reaches five
symbols; reported speech reaches to the end of its clause, after a colon to the end of the next
sentence, and inside quotes, over their sentences, to the closing one. The *clause grammar* reads marked
symbols and accepts insults and threats (a threat needs a modal before or a target after), aimed if a
target is near; each arc weighs a use: aimed, plain, negated or reported. A match weighs its word's
weight times its arc's. The composition's states are built when first met.

The lexicon starts from seed words and is learned from labelled documents: whole words and word
beginnings (inflected words share them) whose documents are toxic far more often than chance allows.
A form's weight is a lower bound of its log-odds, and each use keeps the share of it that its own
documents bear out. A document's score is a logistic function of its matched clauses: their weight
against the number of clauses, the strongest form, the distinct forms, and the numbers of matched and
of all clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_slices, with_columns

# Seed words of the grammar's classes.
INSULTS = "idiot moron stupid dumb loser pathetic worthless scum trash garbage clown disgusting imbecile bastard bitch whore vermin filth freak dimwit jerk creep degenerate idiota imbécil basura escoria payaso idioten dummkopf abschaum müll versager connard imbécile ordure minable débile".split()
THREATS = "kill hurt destroy murder burn stab shoot beat strangle crush matar quemar töten verbrennen tuer brûler".split()
MODALS = "will gonna shall must should voy vas werde wirst vais".split()
TARGETS = "you your yours yourself u he she they them him her tu tú usted vosotros du dich dein ihr vous toi ton".split()
NEGATION = re.compile(r"not|no|nor|never|none|neither|cannot|without|[a-z]+n't|(?:do|does|did|is|are|was|were|wo|ca|could|would|should|have|has|had)nt|nicht|kein(?:e[mnrs]?)?|nie|niemals|ne|n'.+|pas|jamais|nunca|ni")
REPORTS = "said says told claimed wrote quoted called reported dijo sagte schrieb disait écrit".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”«»]")
MARKS = dict.fromkeys(".!?;", "break") | {"\n": "line", ":": "colon"} | dict.fromkeys("\"“”«»", "quote")
SHORTEST, LONGEST = 4, 12  # letters of learned beginnings; whole words are learned at any length
NEGATED = 5  # symbols that a negation reaches
SEED_DOCS = 4  # a seed word counts as if so many toxic documents had shown it
USES = ("aimed", "plain", "negated", "reported")
CLEAR = 3.0  # a use whose documents bear out log-odds of so much keeps its forms' whole weight
ASSUMED = {"aimed": 1.15, "plain": 1.0, "negated": 0.4, "reported": 0.6}


@dataclass
class Grammar:
    """Lexicon weights by word beginning and class, shares by use, and the logistic function: its
    constant and the factors of ``signs``. The default factors stand where there is nothing to learn."""

    prior: float
    weights: dict[str, tuple[str, float]] = field(default_factory=dict)
    shares: dict[str, float] = field(default_factory=lambda: dict(ASSUMED))
    factors: tuple[float, ...] = (0.0, 0.0, 2.0, 0.0, 0.0)


class Scopes:
    """Marks symbols as negated or reported. State: symbols that negation still reaches; whether speech
    is reported (1 to the end of the clause, 2 of the sentence after a colon, 3 of the quotes); whether
    a quote is open."""

    start = (0, 0, False)

    def step(self, state, symbol):
        negated, reported, quoted = state
        if symbol == "line":
            return self.start, symbol
        if symbol == "break":
            return (0, reported if reported == 3 else 0, quoted), symbol
        if symbol == "colon":
            return (0, 2 if reported == 1 else reported, quoted), "break"
        if symbol == "quote":
            if quoted:
                return (0, 0, False), "break"
            return (0, 3 if reported else 0, True), "break"
        mark = "negated" if negated else "reported" if reported else ""
        if symbol == "negation":
            return (NEGATED, reported, quoted), "other"
        if symbol == "report":
            return (max(negated - 1, 0), max(reported, 1), quoted), "other"
        return (max(negated - 1, 0), reported, quoted), (symbol, mark) if symbol in ("insult", "threat") else symbol


class Clauses:
    """Accepts insults and threats of a clause. State: symbols that a target, a modal and an open threat
    (with its mark) still reach. Writes the use of the word just read, or ("late", use) of the open threat."""

    start = (0, 0, 0, "")

    def step(self, state, symbol):
        target, modal, open_, mark = state
        passed = max(target - 1, 0), max(modal - 1, 0), max(open_ - 1, 0), mark if open_ > 1 else ""
        if symbol in ("break", "line"):
            return self.start, None
        if symbol == "target":
            return (6, passed[1], 0, ""), ("late", mark or "aimed") if open_ else None
        if symbol == "modal":
            return (passed[0], 3, 0, ""), None
        if isinstance(symbol, tuple):
            kind, of = symbol
            use = of or ("aimed" if target else "plain")
            if kind == "insult":
                return passed, use
            return ((passed[0], 0, 0, ""), use) if modal else ((passed[0], 0, 3, of), None)
        return passed, None


class Composition:
    """Transducers in a row: each reads what the one before writes. A state is the tuple of their states;
    each step is worked out once."""

    def __init__(self, *machines):
        self.machines, self.table = machines, {}
        self.start = tuple(m.start for m in machines)

    def step(self, state, symbol):
        if (found := self.table.get((state, symbol))) is None:
            after, out = [], symbol
            for m, s in zip(self.machines, state, strict=True):
                s, out = m.step(s, out)
                after.append(s)
            found = self.table[state, symbol] = (tuple(after), out)
        return found


def machine() -> Composition:
    return Composition(Scopes(), Clauses())


class Lexicon:
    """Word -> (symbol, form), remembered for repeated words. A form is the longest known beginning of a
    word; forms of under SHORTEST letters are whole words."""

    def __init__(self, forms: dict[str, str]):
        self.forms = forms
        self.lengths = sorted({len(f) for f in forms if len(f) >= SHORTEST}, reverse=True)
        self.fixed = {w: s for s, ws in (("modal", MODALS), ("target", TARGETS), ("report", REPORTS)) for w in ws}
        self.known: dict[str, tuple[str, str] | None] = {}

    def look_up(self, word: str):
        if word in MARKS:
            return MARKS[word], ""
        for n in self.lengths:
            if n <= len(word) and word[:n] in self.forms:
                return self.forms[word[:n]], word[:n]
        if NEGATION.fullmatch(word):
            return "negation", ""
        if word in self.fixed:
            return self.fixed[word], ""
        return (self.forms[word], word) if word in self.forms else None

    def symbols(self, text: str) -> list[tuple[str, str] | None]:
        """Symbols of a text; None for other words."""
        known, words = self.known, TOKEN.findall(text.lower().replace("\u2019", "'"))
        out = []
        for w in words:
            try:
                out.append(known[w])
            except KeyError:
                if len(known) > 500_000:
                    known.clear()
                known[w] = got = self.look_up(w)
                out.append(got)
        return out


def matches(symbols, run: Composition) -> tuple[Counter, int, int]:
    """Matched clauses by (form, use), the number of matched clauses, and of all clauses."""
    found: Counter = Counter()
    ends = ("break", "line", "colon", "quote")
    clauses = 1 + sum(s is not None and s[0] in ends for s in symbols)
    if not any(s and s[0] in ("insult", "threat") for s in symbols):
        return found, 0, clauses
    matched, here, state, last = 0, set(), run.start, ""
    for s in [*symbols, ("line", "")]:
        symbol, form = s or ("other", "")
        state, out = run.step(state, symbol)
        if symbol in ends:
            found.update(here)
            matched += bool(here)
            here = set()
            continue
        if symbol == "threat":
            last = form
        if out:
            here.add((last, out[1]) if isinstance(out, tuple) else (form, out))
    return found, matched, clauses


def signs(found: Counter, matched: int, clauses: int, grammar: Grammar) -> list[float]:
    """What the score is made of."""
    weight = {k: grammar.weights[k[0]][1] * grammar.shares[k[1]] for k in found}
    forms: dict[str, float] = {}
    for (form, _), w in weight.items():
        forms[form] = max(forms.get(form, 0.0), w)
    total = sum(n * weight[k] for k, n in found.items())
    return [total / (clauses + 4), max(forms.values(), default=0.0), math.log1p(sum(forms.values())), math.log1p(matched), math.log1p(clauses)]


def score(values: list[float], grammar: Grammar) -> float:
    z = grammar.prior + sum(f * v for f, v in zip(grammar.factors, values, strict=True))
    return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """Constant and factors of a ridge logistic regression, by Newton's method on scaled columns."""
    middle, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - middle) / width])
    b, penalty = np.zeros(z.shape[1]), np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(b)), z.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    factors = b[1:] / width
    return float(b[0] - factors @ middle), tuple(map(float, factors))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def log_odds(toxic: float, clean: float, of_toxic: float, of_clean: float, errors: float) -> float:
    """Log-odds of a toxic document given a sign, less ``errors`` standard errors."""
    a, b = toxic + 0.5, clean + 0.5
    return math.log(a / (of_toxic + 1)) - math.log(b / (of_clean + 1)) - errors * math.sqrt(1 / a + 1 / b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: float = 1.5, errors: float = 2.0) -> Grammar:
    """Learn the grammar from at most ``sample`` labelled documents outside the held-out fifth.

    The documents are those with the least hash of their doc_id. Counts by whole word and beginning are
    gathered by Spark; those reach the driver whose log-odds, less ``errors`` standard errors, are
    ``least`` or more, which ``sample`` bounds. Labels that are null are ignored, repeated ones are read
    as toxic if one is. Without labels the seeds stand.
    """
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    chosen = stored(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    texts = stored(docs.join(F.broadcast(chosen), "doc_id").select("__toxic", F.coalesce("text", F.lit("")).alias("text")), "labelled-texts")  # ``sample`` rows of two numbers
    totals = {r["__toxic"]: r["n"] for r in texts.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    prior = math.log((toxic + 1) / (clean + 9))

    def beginnings(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                counts: Counter = Counter()
                for label, text in zip(part.column("__toxic").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = {w for w in TOKEN.findall(text.lower().replace("\u2019", "'")) if w not in MARKS}
                    counts.update((p, label) for p in words | {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)})
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *(pa.array([counts[k] if k[1] == y else 0 for k in keys], pa.int64()) for y in (1, 0))], ["form", "toxic", "clean"])

    seeds = {**dict.fromkeys(INSULTS, "insult"), **dict.fromkeys(THREATS, "threat")}
    counted = texts.mapInArrow(beginnings, "form STRING, toxic LONG, clean LONG").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    bound = F.log(a / (toxic + 1)) - F.log(b / (clean + 1)) - errors * F.sqrt(1 / a + 1 / b)
    counted = stored(counted.withColumn("bound", bound).filter((F.col("bound") >= least) | F.col("form").isin(*seeds)), "beginnings")
    best = counted.filter(F.col("bound") >= least).orderBy(F.col("toxic").desc(), F.length("form").desc(), "form").collect()
    of_seeds = {r.form: (r.toxic, r.clean) for r in counted.filter(F.col("form").isin(*seeds)).collect()}
    grammar = Grammar(prior)
    for form, kind in seeds.items():
        t, c = of_seeds.get(form, (0, 0))
        if (w := log_odds(t + SEED_DOCS, c, toxic + SEED_DOCS, max(clean, 40), errors)) > 0.5:
            grammar.weights[form] = (kind, w)
    begun = {f[:n] for f in grammar.weights for n in range(SHORTEST, len(f) + 1)}
    for r in best:  # of beginnings of one word the most frequent stands, and of equals the longest
        f = r.form
        if f not in grammar.weights and f not in begun and not any(f[:n] in grammar.weights for n in range(SHORTEST, len(f))):
            grammar.weights[f] = ("insult", r.bound)
            begun.update(f[:n] for n in range(SHORTEST, len(f) + 1))

    forms = {f: kind for f, (kind, _) in grammar.weights.items()}

    def uses(batches):
        lexicon_, run = Lexicon(forms), machine()
        for batch in batches:
            counts: Counter = Counter()
            for part in text_slices(batch, "text"):
                for label, text in zip(part.column("__toxic").to_pylist(), part.column("text").to_pylist(), strict=True):
                    counts.update((use, label) for use in {u for _, u in matches(lexicon_.symbols(text), run)[0]})
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["use", "label", "n"])

    seen = {(r.use, r.label): r.n for r in texts.mapInArrow(uses, "use STRING, label INT, n LONG").groupBy("use", "label").agg(F.sum("n").alias("n")).collect()}
    for use in USES:
        t, c = seen.get((use, 1), 0), seen.get((use, 0), 0)
        if t + c >= 10:
            grammar.shares[use] = min(max(log_odds(t, c, toxic, clean, errors) / CLEAR, 0.0), max(ASSUMED[use], 1.0))

    def measured(batches):
        lexicon_, run = Lexicon(forms), machine()
        for batch in batches:
            for part in text_slices(batch, "text"):
                values = [signs(*matches(lexicon_.symbols(t), run), grammar) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("__toxic"), pa.array(values, pa.list_(pa.float64()))], ["label", "values"])

    if toxic >= 10 and clean >= 10:
        rows = texts.mapInArrow(measured, "label INT, values ARRAY<DOUBLE>").collect()  # at most ``sample``
        grammar.prior, grammar.factors = logistic(np.asarray([r["values"] for r in rows]), np.asarray([r.label for r in rows], float))
    return grammar


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 or more).

    Scores depend on the whole text alone, however long. Null and empty texts, and texts without matches, have the
    prior's score. Repeated rows have the same score each; other columns pass; columns named
    ``score`` or ``predicted`` are replaced. An empty table gives an empty result.
    """
    out = with_columns(docs, score=F.lit(0.0), predicted=F.lit(0))
    names = out.columns
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # bounded by the sample it was learned from

    def run(batches):
        grammar = shared.value
        lexicon, composed = Lexicon({f: kind for f, (kind, _) in grammar.weights.items()}), machine()
        for batch in batches:
            for part in text_slices(batch, "text"):
                scores = [score(signs(*matches(lexicon.symbols(t or ""), composed), grammar), grammar) for t in part.column("text").to_pylist()]
                new = {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(names)], names)

    return out.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
