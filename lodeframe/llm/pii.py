"""Personal data by rules and a skip-chain conditional random field.

The rules give the base spans; they always stay. The field runs over the candidate tokens of a
document (accepted spans, and number-like, address-like or user-name-like tokens that no rule
accepted) with the labels other, email, ip, card, phone. Neighbouring candidates share a chain
potential; candidates of equal or similar form (same letters, same last digits), however
far apart, share a skip potential. Loopy sum-product message passing then lets a token that no
rule accepted take the label of the entity it repeats. Skip links join each occurrence to the
one before it, so they grow with the text and not with its square.

The weights (by form, chain and skip) maximise the pseudo-likelihood of a sample of at most `SAMPLE`
documents under a Gaussian prior. What is learned from: every accepted token that repeats another one,
as though the rules had turned it down, and every rejected token without a relative, which is `other`.
The prior means are REJECTED against a token that the rules turned down and LINKED for agreement.
A token that no chain of links joins to an accepted one stays unmarked, so a document without accepted
spans keeps its base spans as they are. Messages are damped and stop when they settle, or after ROUNDS.

Defined cases: null text counts as empty and has no spans; rows with a repeated or null doc_id
are handled row by row; empty tables give no rows; extra columns are ignored; rules, candidates, links
and messages are linear in the text, however long its tokens are.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.components import forest

KINDS = ("email", "ip", "card", "phone")
SAMPLE, REJECTED, LINKED, ROUNDS = 2000, 3.0, 5.0, 60
# fixed values: the forms of the base rules
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
NUMBERS = re.compile(r"[0-9 ().-]{6,}")
NAMES = re.compile(r"[A-Za-z0-9._%+@-]+")
APART = re.compile(r"[._%+-]{2,}")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Each run of dotted numbers splits into fours from its left."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        start, parts = run.start(), run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield start, start + length
            start += length + 1


def base_spans(text: str) -> list[Span]:
    """(kind number, start, end) by kind, then start; every rule is linear in the text."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    if ANY_DIGIT.search(text):
        found += [(1, a, b) for a, b in _ips(text)]
        for m in DIGITS.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


def _form(token: str) -> str:
    digits = sum(map(str.isdigit, token))
    return ("at" if "@" in token else "name" if any(map(str.isalpha, token)) else "dots" if token.count(".") == 3 else "plus" if token[0] == "+" else "number") + str(min(digits, 20))


def _keys(token: str, kind: int) -> list[str]:
    """What equal or similar tokens share."""
    if any(map(str.isalpha, token)):
        local = token.partition("@")[0]
        whole = ["=" + token.casefold().rstrip(".")]
        return whole + ["@" + local.casefold()] * (len(local) >= 5 and any(map(str.isdigit, local)))
    digits = re.sub("[^0-9]", "", token)
    return ["#" + digits] + ["~" + digits[-10:]] * (len(digits) >= 10) if kind != 1 and token.count(".") != 3 else ["=" + token]


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits and their separators, from the first digit or bracket to the last digit; each run is read once."""
    for run in NUMBERS.finditer(text):
        whole = run.group().rstrip(" ().-")
        start = len(whole) - len(whole.lstrip(" ).-"))
        if whole and len(whole) - start >= 7:
            plus = text[run.start() - 1 : run.start()] == "+" and not start and whole[0] != " "
            yield run.start() + start - plus, run.start() + len(whole)


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Joined words with a letter, or what surrounds an at sign."""
    for run in NAMES.finditer(text):
        at, ends = run.start(), [m.span() for m in APART.finditer(run.group())] + [(len(run.group()),) * 2]
        begin = 0
        for low, high in ends:
            part = run.group()[begin:low]
            name = part.strip("._%+-")
            if ("@" in name and len(name) > 1) or (not name.isalnum() and any(map(str.isalpha, name))):
                skip = at + begin + len(part) - len(part.lstrip("._%+-"))
                yield skip, skip + len(name)
            begin = high


def candidates(text: str, base: list[Span]) -> tuple[list[Span], list[tuple[int, int]]]:
    """(label or -1, start, end) in text order, and skip links between them."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    nodes = list(base)
    for a, b in {*_numbers(text), *_names(text)}:
        k = bisect_left(starts, b)
        if not (k and reach[k - 1] > a):
            nodes.append((-1, a, b))
    nodes.sort(key=lambda x: (x[1], x[2], x[0]))
    last: dict[str, int] = {}
    links = set()
    for n, (kind, a, b) in enumerate(nodes):
        for key in _keys(text[a:b], kind):
            if key in last:
                links.add((last[key], n))
            last[key] = n
    return nodes, sorted(links)


def passed(unary: np.ndarray, edges: list[tuple[int, int]], potentials: list[np.ndarray]) -> np.ndarray:
    """Loopy sum-product: log-beliefs of the nodes (node, label)."""
    n, states = unary.shape
    left, right = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
    table = np.stack(potentials)
    to_right, to_left = np.zeros((len(edges), states)), np.zeros((len(edges), states))
    total = unary
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, right, to_right)
        np.add.at(total, left, to_left)
        new_right = np.logaddexp.reduce((total[left] - to_left)[:, :, None] + table, axis=1)
        new_left = np.logaddexp.reduce((total[right] - to_right)[:, None, :] + table, axis=2)
        new_right -= new_right.max(axis=1, keepdims=True)
        new_left -= new_left.max(axis=1, keepdims=True)
        settled = max(np.abs(new_right - to_right).max(), np.abs(new_left - to_left).max()) < 1e-4
        to_right, to_left = 0.5 * (to_right + new_right), 0.5 * (to_left + new_left)
        if settled:
            break
    total = unary.copy()
    np.add.at(total, right, to_right)
    np.add.at(total, left, to_left)
    return total


def _related(kinds: np.ndarray, links: list[tuple[int, int]]) -> np.ndarray:
    """Whether a chain of links joins each node to an accepted one."""
    label = forest(np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64), len(kinds))
    return np.isin(label, label[kinds >= 0])


class Field:
    """Learned potentials: labels by form, chain and skip agreement."""

    def __init__(self, forms: dict[str, list[float]], chain: np.ndarray, skip: float):
        self.forms, self.chain, self.skip = forms, chain, skip

    def added(self, text: str, base: list[Span]) -> list[Span]:
        if not base:
            return []
        nodes, links = candidates(text, base)
        kinds = np.array([k for k, _, _ in nodes])
        open_ = (kinds < 0) & _related(kinds, links) if links else np.zeros(len(nodes), bool)
        if not open_.any():
            return []
        unary = np.full((len(nodes), 5), -30.0)
        unary[np.arange(len(nodes)), kinds + 1] = 0.0
        for n in np.flatnonzero(open_):
            unary[n, 1:] = self.forms.get(_form(text[nodes[n][1] : nodes[n][2]]), [-REJECTED] * 4)
        same = np.diag([0.0, *[self.skip] * 4])  # agreement on an entity counts, agreement on none does not
        edges = [(n, n + 1) for n in range(len(nodes) - 1)] + links
        best = passed(unary, edges, [self.chain] * (len(nodes) - 1) + [same] * len(links)).argmax(axis=1)
        return [(int(best[n]) - 1, *nodes[n][1:]) for n in np.flatnonzero(open_) if best[n] > 0]


def learn(texts: list[str], steps: int = 400, rate: float = 0.5, width: float = 2.0) -> Field:
    """The potentials of the greatest pseudo-likelihood, with a Gaussian prior of standard deviation `width`."""
    names: dict[str, int] = {}
    form, label, left, right, near = [], [], [], [], []
    for text in texts:
        base = base_spans(text)
        if not base:
            continue
        nodes, links = candidates(text, base)
        kinds = np.array([k for k, _, _ in nodes]) + 1
        votes = np.zeros((len(nodes), 5))
        linked = np.zeros(len(nodes), bool)
        for x, y in links:
            linked[[x, y]] = True
            votes[x, kinds[y]] += 1
            votes[y, kinds[x]] += 1
        votes[:, 0] = 0
        for n in np.flatnonzero(((kinds > 0) & (votes.sum(axis=1) > 0)) | ((kinds == 0) & ~linked)):
            form.append(names.setdefault(_form(text[nodes[n][1] : nodes[n][2]]), len(names)))
            label.append(kinds[n])
            left.append(kinds[n - 1] if n else 5)
            right.append(kinds[n + 1] if n + 1 < len(nodes) else 5)
            near.append(votes[n])
    by_form, chain, skip = np.full((len(names), 5), -REJECTED), np.zeros((5, 5)), LINKED
    by_form[:, 0] = 0
    n = len(label)
    if n:
        form, label, left, right, near = np.array(form), np.array(label), np.array(left), np.array(right), np.stack(near)
        truth = np.eye(5)[label]
        for _ in range(steps):
            edge = np.vstack([chain, np.zeros(5)])  # no neighbour beyond an end
            score = by_form[form] + edge[left] + np.vstack([chain.T, np.zeros(5)])[right] + skip * near
            share = np.exp(score - score.max(axis=1, keepdims=True))
            wrong = truth - share / share.sum(axis=1, keepdims=True)
            to_form, to_chain = np.zeros_like(by_form), np.zeros((6, 5))
            np.add.at(to_form, form, wrong)
            np.add.at(to_chain, left, wrong)
            to_right = np.zeros((6, 5))
            np.add.at(to_right, right, wrong)
            prior = width**2
            by_form[:, 1:] += rate * (to_form[:, 1:] - (by_form[:, 1:] + REJECTED) / prior) / (1 + np.bincount(form, minlength=len(names))[:, None])
            chain += rate * (to_chain[:5] + to_right[:5].T - chain / prior) / (1 + n)
            skip += rate * ((wrong * near).sum() - (skip - LINKED) / prior) / (1 + near.sum())
    return Field({k: by_form[i, 1:].tolist() for k, i in names.items()}, chain, float(skip))


def fit(documents: DataFrame, sample: int = SAMPLE) -> Field:
    """Learned in one task from the `sample` documents with personal marks of the smallest hashes."""
    marked = documents.select(
        F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.crc32(F.col("text").cast("binary")).alias("c")
    ).where("instr(text, '@') > 0 or text rlike '[0-9]'")
    # the hashes alone decide; only the texts of the sample move
    edge = marked.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = marked.where(F.col("h") <= F.lit(edge)).orderBy("h", "c").limit(sample).select("text")

    def run(table: pa.Table) -> pa.Table:
        field = learn(sorted(table["text"].to_pylist()))
        return pa.table({"field": [json.dumps([field.forms, field.chain.tolist(), field.skip])]})

    row = some.groupBy(F.lit(0).alias("one")).applyInArrow(run, "field string").first()
    if row is None:
        return learn([])
    forms, chain, skip = json.loads(row["field"])
    return Field(forms, np.array(chain), skip)


def spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each by kind, then start."""
    base = base_spans(text)
    more = field.added(text, base)
    return base, sorted({*base, *more})


def _joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def personal(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = field or fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(x or "", field) for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([_joined(s) for _, s in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in found):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame) -> DataFrame:
    """All columns of documents, personal data in `text` replaced by its kind in brackets."""
    field = fit(documents)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [x and masked(x, spans(x, field)[1]) for x in batch.column(place).to_pylist()]
            yield batch.set_column(place, "text", pa.array(new, pa.string()))

    return documents.mapInArrow(run, documents.schema)
