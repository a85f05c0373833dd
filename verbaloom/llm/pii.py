"""Personal data: base patterns, and a skip-chain conditional random field that makes labels agree within a document.

The base patterns find emails, addresses, cards and phones. Their spans label the tokens of a bounded sample, on which node,
chain and skip weights are trained together by pseudo-likelihood. Tokens with a digit, an @ or a written-out at are the
field's variables, all others are observed to be no entity. Chain edges join neighbours. Skip edges join mentions of one
value, however far apart and however they are written: the same token, a run of tokens with the same digits (a phone in
groups and in one piece), four numbers that make one address, one email with its signs spelt out. Each mention is joined to
the one before it and to one that a base pattern has found. Loopy sum-product passes messages for all documents of a slab
at once until they settle. A token whose belief in a label passes the limit adds a span, unless it touches a base span;
base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import need

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
#: Sample for training: at most so many documents with a digit or an @, of at most so many characters each, out of so
#: many times as many documents chosen by hash. All that can reach the driver is their product.
SAMPLE_DOCUMENTS = 2_000
SAMPLE_CHARS = 4_000
SAMPLE_FROM = 8
MIN_BELIEF = 0.9
#: Messages have settled when none changes by more; loopy graphs needn't settle, so rounds end at a fixed number.
SETTLED = 1e-3
ROUNDS = 200
#: Features of the field, the most frequent first; a rarer one counts as unknown. Only the first characters of a token
#: make its shape; what is labelled is the whole token.
MAX_FEATURES = 2_400
SHAPE_CHARS = 64
#: What mentions of one value gain by agreeing, before training; training moves it.
AGREEMENT = 7.0
#: The share of tokens without a base span that training takes to be entities the patterns missed.
MISSED = 0.05

_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: None of these can begin after a digit: a match before it would have taken that digit too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'.,;:!?()[]{}<>*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, one look at each @: the local part reaches back as far as it can."""
    out, end, at = [], 0, text.find("@")
    local = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    floor = 0
    while at >= 0:
        start = at
        while start > max(end, floor) and text[start - 1] in local:
            start -= 1
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kind by its place in KINDS, sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in find_emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Runs of digits and of letters as one mark each; long shapes count as one."""
    s = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", token[:SHAPE_CHARS]))
    return s if len(s) <= 16 else "long"


def spelt(token: str) -> str:
    """An email with its at and dots as signs, in lower case."""
    return re.sub(r"[(\[{]dot[)\]}]", ".", re.sub(r"[(\[{]at[)\]}]", "@", token.lower()))


class Mention:
    """A variable token: where it stands, its digits, and the run of number tokens it belongs to."""

    __slots__ = ("place", "token", "start", "end", "digits", "run", "run_digits")

    def __init__(self, place: int, token: str, start: int) -> None:
        self.place, self.token, self.start, self.end = place, token, start, start + len(token)
        self.digits = "".join(c for c in token if c in "0123456789")
        self.run, self.run_digits = -1, ""


def mentions_of(text: str, near: list[re.Match]) -> list[Mention]:
    """The variables among some tokens, with the runs of numbers that only blanks and brackets part."""
    out: list[Mention] = []
    runs: list[list[Mention]] = []
    for i, m in enumerate(near):
        token = m[0].strip(_EDGE) or m[0]
        x = Mention(i, token, m.start() + m[0].index(token))
        if not x.digits and "@" not in spelt(token):
            continue
        number = not token.strip("0123456789+-./()")
        if number and out and runs and runs[-1][-1] is out[-1] and len(gap := text[out[-1].end : x.start]) <= 3 and not gap.strip(" ()-.") and "+" not in token:
            runs[-1].append(x)
        elif number:
            runs.append([x])
        out.append(x)
    for k, run in enumerate(runs):
        digits = "".join(x.digits for x in run)
        for x in run:
            x.run, x.run_digits = k, digits
    return out


def keys_of(x: Mention) -> list[str]:
    """What a mention says, in ways that other mentions of the same value say too; nothing for tokens that say too little."""
    out = []
    if "@" in (plain := spelt(x.token)) and "." in plain.partition("@")[2]:
        out.append("e" + plain)
    for digits in {x.digits, x.run_digits}:
        if len(digits) >= 7:
            out.append("d" + digits)
        if len(digits) >= 9:
            out.append("s" + digits[-9:])  # a number with and without its country code
    parts = re.findall("[0-9]+", x.token)
    if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not x.token.startswith("+"):
        out.append("i" + ".".join(str(int(p)) for p in parts))
    return out


class Nodes:
    """The variables of some documents, their features and edges."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.features: list[tuple[str, ...]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.gold: list[int] = []  # the label of the base span that holds the token

    def add(self, doc: int, text: str, spans: list[tuple[int, int, int]], near: list[re.Match]) -> None:
        found, base, k = mentions_of(text, near), len(self.doc), 0
        said: dict[str, list[int]] = {}
        chained: set[tuple[int, int]] = set()
        for j, x in enumerate(found):
            m, i = near[x.place], x.place
            neighbour = lambda j: shape(near[j][0].strip(_EDGE)) if 0 <= j < len(near) and min(abs(near[j].start() - m.end()), abs(near[j].end() - m.start())) <= 2 else "-"  # noqa: B023, E731
            card = 12 <= len(x.digits) <= 19 and len(x.digits) == len(x.token)
            parts = x.token.split(".")
            address = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
            self.features.append((f"s:{shape(x.token)}", f"d:{min(len(x.digits), 24)}", f"c:{card and luhn(x.digits)}", f"i:{address}", f"e:{'@' in x.token and '.' in x.token.partition('@')[2]}", f"p:{neighbour(i - 1)}", f"n:{neighbour(i + 1)}", f"r:{min(len(x.run_digits), 24)}"))
            while k < len(spans) and spans[k][2] <= x.start:
                k += 1
            label, q = 0, k
            while not label and q < len(spans) and spans[q][0] <= x.start:
                label = 1 + spans[q][1] if x.end <= spans[q][2] else 0
                q += 1
            self.gold.append(label)
            self.doc.append(doc)
            self.start.append(x.start)
            self.end.append(x.end)
            n = base + j
            if j and found[j - 1].place == i - 1:
                self.chain.append((n - 1, n))
                chained.add((n - 1, n))
            for key in keys_of(x):
                said.setdefault(key, []).append(n)
        edges: set[tuple[int, int]] = set()
        run = lambda n: (r := found[n - base].run) >= 0 and r
        for nodes in said.values():
            sure = next((n for n in nodes if self.gold[n]), None)
            for before, n in zip([None, *nodes], nodes):  # noqa: B905
                for other in {before, sure} - {None, n}:
                    pair = (min(other, n), max(other, n))
                    if pair not in chained and (run(other) is False or run(other) != run(n)):
                        edges.add(pair)
        self.skip += sorted(edges)


def tokens_near(text: str) -> list[re.Match]:
    """The tokens with a digit, an @ or a written-out at, and those next to them, in order; the rest of a text is passed by."""
    out: list[re.Match] = []
    for m in re.finditer(r"[0-9@]|[(\[{][Aa][Tt][)\]}]", text):
        if out and m.start() < out[-1].end():
            continue
        s = m.start()
        while s > 0 and text[s - 1] not in " \t\n\x0b\x0c\r":
            s -= 1
        t = _TOKEN.match(text, s)
        p = s
        while p > 0 and text[p - 1] in " \t\n\x0b\x0c\r":
            p -= 1
        q = p
        while q > 0 and text[q - 1] not in " \t\n\x0b\x0c\r":
            q -= 1
        if q < p and (not out or out[-1].start() < q):
            out.append(_TOKEN.match(text, q))
        if not out or out[-1].start() < s:
            out.append(t)
        after = _TOKEN.search(text, t.end())
        if after:
            out.append(after)
    return out


class Field:
    """Trained potentials, as logarithms."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.index, self.weights, self.chain, self.skip = index, weights, chain, skip

    def matrix(self, features: list[tuple[str, ...]]) -> np.ndarray:
        width = len(features[0]) if features else 1
        return np.array([[self.index.get(f, 0) for f in row] for row in features], dtype=np.int64).reshape(-1, width)

    def node(self, features: list[tuple[str, ...]]) -> np.ndarray:
        score = self.weights[self.matrix(features)].sum(axis=1) + self.weights[1]
        return score - score.max(axis=1, keepdims=True)

    def beliefs(self, nodes: Nodes, fixed: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Marginals by loopy sum-product with damping; fixed labels above 0 are evidence."""
        local = self.node(nodes.features)
        known = fixed > 0
        local[known] = -1e6  # no number of neighbours outvotes what is known
        local[known, fixed[known]] = 0.0
        edges = np.array(nodes.chain + nodes.skip, dtype=np.int64).reshape(-1, 2)
        if len(edges):
            kinds = np.array([0] * len(nodes.chain) + [1] * len(nodes.skip))
            tables = np.stack([self.chain, self.skip])[kinds]
            source = np.concatenate([edges[:, 0], edges[:, 1]])
            target = np.concatenate([edges[:, 1], edges[:, 0]])
            table = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            messages = np.zeros((len(source), len(LABELS)))
            for _ in range(rounds):
                total = local.copy()
                np.add.at(total, target, messages)
                sent = np.logaddexp.reduce((total[source] - messages[back])[:, :, None] + table, axis=1)
                sent -= np.logaddexp.reduce(sent, axis=1, keepdims=True)
                moved = float(np.abs(sent - messages).max())
                messages = 0.5 * messages + 0.5 * sent
                if moved < SETTLED:
                    break
            np.add.at(local, target, messages)
        return np.exp(local - np.logaddexp.reduce(local, axis=1, keepdims=True))


def neighbour_labels(edges: list[tuple[int, int]], labels: np.ndarray) -> np.ndarray:
    """How many neighbours of each label a node has."""
    out = np.zeros((len(labels), len(LABELS)))
    if edges:
        e = np.array(edges)
        np.add.at(out, (e[:, 0], labels[e[:, 1]]), 1)
        np.add.at(out, (e[:, 1], labels[e[:, 0]]), 1)
    return out


def train(texts: list[str], epochs: int = 300) -> Field:
    """All weights together, by the pseudo-likelihood of each token's label given its features and its neighbours' labels.

    Base spans are the labels; tokens without one are nothing but for a share that patterns miss. A token that no pattern found but that says the same as one that a pattern did is not known
    to be nothing, so it isn't trained on. A copy of each labelled token with a labelled mention elsewhere is trained on
    with its features hidden, so that what mentions tell each other is learnt too. Agreement weights are drawn towards
    AGREEMENT, all others towards 0.
    """
    nodes = Nodes()
    for i, t in enumerate(texts):
        nodes.add(i, t, base_spans(t), tokens_near(t))
    counts: dict[str, int] = {}
    for row in nodes.features:
        for f in row:
            counts[f] = counts.get(f, 0) + 1
    common = sorted((f for f in counts if counts[f] >= 3), key=lambda f: (-counts[f], f))[:MAX_FEATURES]
    index = {f: i + 2 for i, f in enumerate(common)}  # 0: unknown, 1: bias
    agree = AGREEMENT * np.eye(len(LABELS))
    field = Field(index, np.zeros((len(index) + 2, len(LABELS))), np.zeros((5, 5)), agree.copy())
    if not nodes.features:
        field.weights[1, 0] = 5.0
        return field
    labels = np.array(nodes.gold)
    x, y = field.matrix(nodes.features), np.eye(len(LABELS))[labels]
    y[labels == 0] = [1 - MISSED, *[MISSED / len(KINDS)] * len(KINDS)]
    near, far = neighbour_labels(nodes.chain, labels), neighbour_labels(nodes.skip, labels)
    sure = (labels > 0) | (far[:, 1:].sum(axis=1) == 0)
    hidden = np.flatnonzero((labels > 0) & (far[:, 1:].sum(axis=1) > 0))
    x, y = np.concatenate([x[sure], np.zeros_like(x[hidden])]), np.concatenate([y[sure], y[hidden]])
    near, far = np.concatenate([near[sure], 0 * near[hidden]]), np.concatenate([far[sure], far[hidden]])
    seen = np.arange(len(y)) < int(sure.sum())  # the hidden ones have no say in the bias either
    field.weights[1] = np.log((y[seen].sum(axis=0) + 1) / (seen.sum() + len(LABELS)))
    parts = [field.weights, field.chain, field.skip]
    steps = [np.zeros_like(w) + 1e-6 for w in parts]
    for _ in range(epochs):
        score = field.weights[x].sum(axis=1) + np.outer(seen, field.weights[1]) + near @ field.chain + far @ field.skip
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - y) / len(y)
        grads = [1e-3 * field.weights, near.T @ error + 1e-3 * field.chain, far.T @ error + 1e-3 * (field.skip - agree)]
        np.add.at(grads[0], x.ravel(), np.repeat(error, x.shape[1], axis=0))
        grads[0][1] += error[seen].sum(axis=0)
        grads[0][0] = 0
        for k in (1, 2):
            grads[k] = (grads[k] + grads[k].T) / 2
        for w, g, step in zip(parts, grads, steps, strict=True):
            step += g**2
            w -= 0.5 * g / np.sqrt(step)
    return field


def added_spans(field: Field, texts: list[str], spans: list[list[tuple[int, int, int]]], min_belief: float) -> list[list[tuple[int, int, int]]]:
    """What the field finds beside the base spans; neighbours of one label join if only blanks part them."""
    nodes = Nodes()
    for i, t in enumerate(texts):
        nodes.add(i, t, spans[i], tokens_near(t))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not nodes.doc:
        return out
    # Tokens in base spans are known, so their evidence is certain.
    fixed = np.array(nodes.gold)
    belief = field.beliefs(nodes, fixed)
    best = belief.argmax(axis=1)
    last = None
    for i in np.flatnonzero((best > 0) & (belief.max(axis=1) >= min_belief) & (fixed == 0)).tolist():
        d, s, e, k = nodes.doc[i], nodes.start[i], nodes.end[i], int(best[i]) - 1
        if any(a < e and s < b for a, _, b in spans[d]):
            continue
        # Pieces of one number join if they are not too many digits together.
        if last and last[0] == d and k in (2, 3) and out[d][-1][1] == k and last[1] == i - 1 and not texts[d][out[d][-1][2] : s].strip(" ()-.") and sum(c in "0123456789" for c in texts[d][out[d][-1][0] : e]) <= (19 if k == 2 else 15):
            out[d][-1] = (out[d][-1][0], k, e)
        else:
            out[d].append((s, k, e))
        last = (d, i)
    return out


#: What a text has to hold to have a variable: a digit, an @, or a bracket of a written-out at.
_MARKS = b"0123456789@([{"
SCHEMA = "doc_id long, base array<struct<start:long,kind:string,end:long>>, added array<struct<start:long,kind:string,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def scan_fn(field: Field, min_belief: float, with_text: bool = False):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]
        marks = np.zeros(256, dtype=bool)
        marks[list(_MARKS)] = True
        for batch in batches:
            texts = batch.column(1)
            for low, high, data, offsets in B.slabs(texts):
                seen = np.concatenate([[0], np.cumsum(marks[data])])
                rows = np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]]).tolist()  # the rest has nothing to label
                some = texts.slice(low, high - low).take(pa.array(rows, pa.int64())).to_pylist()
                spans = [base_spans(t) for t in some]
                more = added_spans(field, some, spans, min_belief)
                base, added = [[] for _ in range(high - low)], [[] for _ in range(high - low)]
                for r, s, m in zip(rows, spans, more, strict=True):
                    base[r], added[r] = told(s), told(m)
                columns = [batch.column(0).slice(low, high - low).cast(pa.int64()), pa.array(base, _SPAN), pa.array(added, _SPAN)]
                yield pa.RecordBatch.from_arrays([*columns, *[texts.slice(low, high - low)] * with_text], names=["doc_id", "base", "added", *["text"] * with_text])

    return scan


def find_pii(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_documents: int = SAMPLE_DOCUMENTS, sample_chars: int = SAMPLE_CHARS, min_belief: float = MIN_BELIEF, field: Field | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, base and added spans (start, kind, end in code points) of every document row.

    The field is trained on at most sample_documents texts, chosen by a hash of their id; the scan covers all rows and whole
    texts. Null and empty texts have no spans. Repeated rows are judged alike, null ids kept. On an empty table nothing
    is trained and the result is empty. Other columns are ignored.
    """
    need(documents, id_col, text_col)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if field is None:
        share = min(1.0, SAMPLE_FROM * sample_documents / max(docs.count(), 1))
        chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
        sample = docs.where(chosen & (F.length("text") <= sample_chars) & F.col("text").rlike("[0-9@]"))
        field = train([r.text for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_documents).select("text").collect()])
    return docs.mapInArrow(scan_fn(field, min_belief, with_text), SCHEMA + (", text string" if with_text else ""))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their hash, and all spans as kind:start:end by start, then kind as listed."""
    order = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x.start.alias("s"), F.array_position(order, x.kind).alias("k"), x.kind.alias("kind"), x.end.alias("e")))), lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def mask(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and the text of every row with each span replaced by its kind in angle brackets.

    Rows that repeat an id or have none stay as many as they are; a null text stays null. An empty table gives an empty
    result; other columns are ignored.
    """
    found = find_pii(documents, id_col=id_col, text_col=text_col, with_text=True, **options)
    spans = found.select("doc_id", F.col("text").alias("t"), F.array_sort(F.concat("base", "added")).alias("spans"))
    fold = "aggregate(spans, struct(0L AS at, '' AS out), (a, x) -> IF(x.start < a.at, a, struct(x.end AS at, a.out || substring(t, CAST(a.at + 1 AS INT), CAST(x.start - a.at AS INT)) || '<' || x.kind || '>' AS out)), a -> a.out || substring(t, CAST(a.at + 1 AS INT)))"
    return spans.select("doc_id", F.expr(fold).alias("text"))
