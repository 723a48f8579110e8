r"""Personal data: fixed patterns, and further spans found by weak supervision.

Four kinds (email, ip, card, phone) are found by pattern alone. Further candidates (national ids, bank
accounts, dates of birth, local phone numbers, disguised addresses, names) get votes from four labelers: a strict
regex, a gazetteer, the words before, and the words that speak against. Candidates inside a base span are known to be
personal data; they are counted as labelled ones and never reported themselves.

The votes of all candidates in the corpus are counted by kind and value, a few thousand different ones at most;
expectation-maximisation over these counts estimates how reliable each labeler is for each kind. Two groups have fixed labels:
candidates inside base spans are real, and those that some labeler is against and none is for are not. Real ones together weigh no
more than the other candidates and the prior, and the share of real ones is estimated without them: they were chosen for being
real, so they say nothing about the rest. The posteriors are the labels on which the final span classifier is trained: a
logistic regression over votes, kind, the candidate's characters and length and the words around it, hashed to 2**BITS
features. It is trained on at most `sample` candidates, those with the smallest hash, each also shown with other votes and the posterior of
those, and on the votes that labelers can give each kind alone; so votes that the corpus doesn't show, or shows in real ones only,
still count as the labelers' reliabilities say. It decides about every candidate.

Patterns run in time linear in the text, also over long runs of digits or address characters, and have no upper bounds of their own;
context is `window` characters, and dates of birth are in `years`.

Defined results: a null text counts as empty and has no spans; very long texts are searched whole; repeated rows are handled
alike; a null doc_id is passed on; an empty table gives an empty result; other columns are never read. With no candidates
anywhere the labelers keep their prior reliabilities.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread, staged, table, text_of, workspace

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """From each @ to the left as far as its local part goes: the leftmost match, without trying every start."""
    end, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# Candidates. Each kind has a loose pattern and its labelers' knowledge.
ID, IBAN, BIRTH, LOCAL_PHONE, DISGUISED, NAME = "national_id", "iban", "birth_date", "local_phone", "hidden_email", "person"
MORE = (ID, IBAN, BIRTH, LOCAL_PHONE, DISGUISED, NAME)
LOOSE = {
    ID: re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    IBAN: re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    BIRTH: re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9]|[./-][0-9])"),
    LOCAL_PHONE: re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
}
AT = re.compile(r" ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++)++")
WORD = r"\p{Lu}[\p{L}\p{M}'’-]*+"
PERSON = regex.compile(rf"(?<![\p{{L}}])(?:(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Señor|Señora)\.? {WORD}(?: {WORD})*+|(?<=[Nn]ame: ){WORD}(?: {WORD})++)")
HAS_DIGIT_PAIR = re.compile(r"[0-9][0-9]")
TITLES = ("Mr", "Ms", "Dr", "Herr", "Frau", "Mme", "Señor", "ame: ")
CONTEXT = {
    ID: ("ssn", "social security", "national id", "tax id"),
    IBAN: ("iban", "account", "konto", "compte", "cuenta", "bank"),
    BIRTH: ("born", "birth", "dob", "geboren", "geburt", "né", "naissance", "nacid", "nacimiento"),
    LOCAL_PHONE: ("phone", "call", "tel", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "+"),
    DISGUISED: ("mail", "contact", "write", "reach"),
    NAME: ("name", "contact", "from", "dear", "signed", "regards", "patient", "customer"),
}
AGAINST = ("version", "isbn", "part no", "serial", "order", "released", "page", "chapter", "error", "ticket", "$", "€", "#")
# Given names common in English, German, French and Spanish.
GIVEN = frozenset(
    """adam alan albert alejandro alex alexander alice amy ana andrea andreas andrew angela anna anne antoine antonio arthur barbara benjamin bernard
    bernd brian camille carlos carmen caroline catherine charles charlotte chloé christian christine christopher claire claudia claudine cristina dagmar daniel david
    deborah diego dieter dietmar dolores donald dorothy edward elena elizabeth emily emma enrique eric ernst eva felix fernando francisco françois françoise frank fritz
    gabriel georg george gérard gisela guillaume günter hannah hans harald heike heinrich helen helga henri hugo ingrid isabel jack jacques james jan
    javier jean jennifer jessica joan johann john jonas jorge josé jose joseph juan jürgen julia karen karin karl katharina kevin klaus laura lena léa linda
    lisa louis luc lucas lucía luis lukas manuel manon marc margaret maria maría marie mario mark markus marta martin mary matthew max mercedes michael michel
    miguel monika nancy nathalie nicolas nicole olivier otto pablo pascal patricia paul paula pedro peter petra philippe pierre pilar rafael ramón raúl renate
    richard robert rosa ruth sabine samuel sandra sarah sergio simon sofía sophie stefan stephen susan susanne sylvie teresa theo thomas ursula uwe véronique
    walter werner wilhelm william wolfgang yves""".split()
)
# Lengths of account numbers by country, of the IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
ENDINGS = frozenset("com org net edu gov info io de at ch fr be es it nl pt uk eu".split())
N_LABELERS = 4
WINDOW = 40  # characters before a candidate that its context is
YEARS = (1900, 2099)
BITS = 16
OTHERS = 2  # examples with other votes that a candidate gives
SAMPLE = 8_000  # candidates that the classifier is trained on, at most


def _strict(kind: str, s: str, years: tuple[int, int] = YEARS) -> int:
    """1 or -1: the strict form holds or fails; 0: it says nothing."""
    if kind == ID:
        a, b, c = re.split("[- ]", s)
        return 1 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else -1
    if kind == IBAN:
        s = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    if kind == BIRTH:
        parts = [int(x) for x in re.split("[./-]", s)]
        y, m, d = parts if len(s) == 10 and s[4] == "-" else parts[::-1]
        return 1 if years[0] <= y <= years[1] and 1 <= min(m, d) and max(m, d) <= 31 and min(m, d) <= 12 else -1
    if kind == LOCAL_PHONE:
        return 1 if s.lstrip("(")[0] not in "01" else -1
    return 0


def _gazetteer(kind: str, s: str) -> int:
    if kind == NAME:
        return 1 if any(w.lower() in GIVEN for w in re.split("[ -]", s)) else 0
    if kind == IBAN:
        return 1 if IBAN_LENGTHS.get(s[:2]) == len(s.replace(" ", "")) else -1
    if kind == DISGUISED:
        return 1 if re.split(r"[ \])]", s)[-1].lower() in ENDINGS else 0
    return 0


def _matches(text: str) -> Iterator[tuple[str, int, int]]:
    if HAS_DIGIT_PAIR.search(text):
        for kind, pattern in LOOSE.items():
            yield from ((kind, *m.span()) for m in pattern.finditer(text))
    if ("(" in text or "[" in text) and "at" in text:
        end = 0
        for m in AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in HIDDEN:
                start -= 1
            if start < m.start():
                end = m.end()
                yield DISGUISED, start, end
    if any(t in text for t in TITLES):
        yield from ((NAME, *m.span()) for m in PERSON.finditer(text))


HIDDEN = LOCAL - frozenset("%+")


def _form(s: str) -> str:
    """The kinds of characters, runs of letters taken together."""
    return re.sub("a{2,}", "a", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s))


def _said(kind: str, votes: str) -> list[str]:
    return [f"kind={kind}", *(f"v{i}{v}" for i, v in enumerate(votes)), *(f"kv{kind}{i}{v}" for i, v in enumerate(votes))]


def _hashed(said: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in said]


def _features(kind: str, votes: str, s: str, before: str, after: str) -> list[int]:
    """Hashed features: kind, votes, characters and length, words around."""
    words = before.split()[-2:]
    around = [f"last={kind}:{words[-1]}" if words else "last=", f"then={kind}:{(after.split() or [''])[0]}", *(f"near={w}" for w in words)]
    return _hashed([*_said(kind, votes), f"form={kind}:{_form(s)}", f"long={kind}:{min(9, len(s) // 4)}", *around])


def candidates(text: str, base: list[tuple[int, int, int]] = (), window: int = WINDOW, years: tuple[int, int] = YEARS) -> list[dict]:
    """Candidate spans with their labelers' votes and features; state 1: inside a base span, -1: overlapping one, 0: clear."""
    out = []
    spans = sorted((a, b) for a, _, b in base)
    starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    for kind, a, b in _matches(text):
        s, before = text[a:b], text[max(0, a - window) : a].lower()
        votes = (_strict(kind, s, years), _gazetteer(kind, s), 1 if any(w in before for w in CONTEXT[kind]) else 0, -1 if any(w in before for w in AGAINST) else 0)
        said = "".join("-0+"[v + 1] for v in votes)
        i, j = bisect_right(starts, a), bisect_left(starts, b)
        state = 1 if i and reach[i - 1] >= b else -1 if j and reach[j - 1] > a else 0
        out.append({"start": a, "end": b, "kind": kind, "votes": said, "state": state, "features": _features(kind, said, s, before, text[b : b + window].lower())})
    return out


CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("votes", pa.string()), ("state", pa.int32()), ("features", pa.list_(pa.int32()))])
FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("starts", pa.list_(pa.int32())), ("candidates", pa.list_(CANDIDATE))])
FOUND_DDL = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, starts array<int>, "
    "candidates array<struct<start: int, end: int, kind: string, votes: string, state: int, features: array<int>>>"
)


def _find(batches: Iterator[pa.RecordBatch], window: int = WINDOW, years: tuple[int, int] = YEARS) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = base_spans(text)
            said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
            row = {"doc_id": doc_id, "base": said, "starts": [a for a, _, _ in base], "candidates": candidates(text, base, window, years)}
            rows.append(row | {f"n_{k}": sum(x[1] == i for x in base) for i, k in enumerate(KINDS)})
        yield pa.RecordBatch.from_pylist(rows, schema=FOUND)


def possible_votes(kind: str) -> list[str]:
    """All votes that labelers can give a candidate of this kind."""
    strict = "-+" if kind in LOOSE else "0"
    gazetteer = "-+" if kind == IBAN else "0+" if kind in (NAME, DISGUISED) else "0"
    return ["".join(v) for v in product(strict, gazetteer, "0+", "-0")]


class Labelers:
    """Reliabilities by kind, and the posterior of each kind and votes, by expectation-maximisation."""

    PRIOR = 20  # candidates that it is worth

    def __init__(self, counts: list[tuple[str, str, bool, int]], rounds: int = 50):
        """counts: (kind, votes, whether labelled as real, how often), each different triple once."""
        # p(vote | span is real or not), with a prior that trusts each labeler a little
        prior = self.PRIOR * np.stack([np.tile([0.30, 0.50, 0.20], (N_LABELERS, 1)), np.tile([0.05, 0.40, 0.55], (N_LABELERS, 1))])
        self.reliability, self.share, self.posterior = {}, {}, {}
        for kind in MORE:
            mine = [c for c in counts if c[0] == kind]
            n = np.array([c[3] for c in mine], float)
            votes = np.array([["-0+".index(v) for v in c[1]] for c in mine], np.int64).reshape(-1, N_LABELERS)
            known = np.array([c[2] for c in mine], bool)
            against = np.array(["-" in c[1] and "+" not in c[1] for c in mine], bool) & ~known
            weight = np.where(known, n * min(1.0, (n[~known].sum() + self.PRIOR) / max(1.0, n[known].sum())), n)
            held, share = prior / prior.sum(-1, keepdims=True), 0.3
            for _ in range(rounds):
                post = np.where(known, 1.0, np.where(against, 0.0, self._real(held, share, votes)))
                for z, q in ((0, 1 - post), (1, post)):
                    seen = np.array([[(weight * q)[votes[:, i] == v].sum() for v in range(3)] for i in range(N_LABELERS)]) + prior[z]
                    held[z] = seen / seen.sum(-1, keepdims=True)
                share = ((n * post)[~known].sum() + 3) / (n[~known].sum() + 10)
            self.reliability[kind], self.share[kind] = held, share
            every = sorted({*possible_votes(kind), *(c[1] for c in mine)})
            coded = np.array([["-0+".index(v) for v in x] for x in every], np.int64)
            for x, p in zip(every, self._real(held, share, coded).tolist(), strict=True):
                self.posterior[kind, x] = p

    @staticmethod
    def _real(held: np.ndarray, share: float, votes: np.ndarray) -> np.ndarray:
        log = [np.log(p) + sum(np.log(held[z, i, votes[:, i]]) for i in range(N_LABELERS)) for z, p in ((0, 1 - share), (1, share))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


class SpanClassifier:
    """Logistic regression over hashed features, by adaptive gradient steps."""

    def __init__(self, examples: list[tuple[list[int], float]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-3):
        self.w, self.bias = np.zeros(1 << BITS), 0.0
        seen, bias_seen = np.full(1 << BITS, 1e-8), 1e-8
        order = np.random.default_rng(10)
        for _ in range(epochs):
            for i in order.permutation(len(examples)).tolist():
                at, y = examples[i]
                at = np.array(sorted(set(at)))
                off = 1 / (1 + np.exp(-np.clip(self.w[at].sum() + self.bias, -35, 35))) - y
                g = off + l2 * self.w[at]
                seen[at] += g * g
                self.w[at] -= rate * g / np.sqrt(seen[at])
                bias_seen += off * off
                self.bias -= rate * off / np.sqrt(bias_seen)

    def probabilities(self, features: list[list[int]]) -> np.ndarray:
        if not features:
            return np.empty(0)
        sizes = [len(set(f)) for f in features]
        flat = np.fromiter((x for f in features for x in set(f)), np.int64, sum(sizes))
        z = np.add.reduceat(self.w[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]])) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fitted(found: DataFrame, sample: int = SAMPLE) -> SpanClassifier:
    """From the rows of _find: reliabilities of the labelers over all candidates, and the classifier trained on their posteriors."""
    each = found.select("doc_id", F.explode("candidates").alias("c")).where("c.state >= 0")
    counts = each.groupBy("c.kind", "c.votes", (F.col("c.state") == 1).alias("known")).count().sort("kind", "votes", "known")
    labelers = Labelers([tuple(r) for r in counts.collect()])  # at most kinds * 3**labelers * 2 rows
    order = F.xxhash64("doc_id", "c.start", "c.kind")
    some = each.select(order.alias("h"), "doc_id", "c.kind", "c.votes", "c.state", "c.features").orderBy("h", "doc_id", "kind", "votes", "features").limit(sample).collect()
    return SpanClassifier(examples_of([(r["kind"], r["votes"], r["state"] == 1, r["features"]) for r in some], labelers))


def examples_of(rows: list[tuple[str, str, bool, list[int]]], labelers: Labelers) -> list[tuple[list[int], float]]:
    """What the classifier learns of candidates (kind, votes, whether known as real, features): each as it is, and OTHERS times with other
    votes and the posterior of these, so that what stands around real ones doesn't replace votes; and each kind's possible votes alone."""
    out = []
    for kind, votes, known, features in rows:
        out.append((features, 1.0 if known else labelers.posterior[kind, votes]))
        every = possible_votes(kind)
        for i in range(OTHERS):
            other = every[xxhash.xxh32_intdigest(f"{features} {i}") % len(every)]
            said = _hashed(_said(kind, other))
            out.append(([*said, *features[len(said) :]], labelers.posterior[kind, other]))
    return [*out, *((_hashed(_said(kind, votes)), p) for (kind, votes), p in sorted(labelers.posterior.items()))] if rows else []


def find_personal_data(docs: DataFrame, path: str | None = None, threshold: float = 0.6, sample: int = SAMPLE, window: int = WINDOW, years: tuple[int, int] = YEARS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; spans also holds what the classifier accepts."""
    spark = docs.sparkSession
    found = staged(spread(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))).mapInArrow(lambda batches: _find(batches, window, years), FOUND_DDL), f"{path or workspace(spark, 'pii')}/found")
    model = fitted(found, sample)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, starts, lists = (batch.column(i).to_pylist() for i in (5, 6, 7))
            likely = iter(model.probabilities([c["features"] for found in lists for c in found]).tolist())
            spans = []
            for said, at, found in zip(base, starts, lists, strict=True):
                more = [(c["start"], len(KINDS), f"{c['kind']}:{c['start']}:{c['end']}") for c in found if next(likely) >= threshold and c["state"] == 0]
                if more:
                    every = [(a, [*KINDS].index(x.partition(":")[0]), x) for a, x in zip(at, said.split(","), strict=True)] if said else []
                    said = ",".join(x[2] for x in sorted(every + more))
                spans.append(said)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(digests, pa.string()), pa.array(spans, pa.string())], schema=RESULT)

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


RESULT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
