"""Secret scans: candidate tokens are kept or dropped by a random forest trained on labelled findings.

Candidates are strings of known key formats, values assigned to names such as ``password`` or ``api_key`` (of any
length and alphabet), and tokens that could be keys (long, with a digit or all capitals). Findings are labelled by
formats and assignments; those that are neither clearly secret nor clearly a false alarm have no label and teach
nothing. The forest decides all of them, labelled or not. It sees the length, transitions between character classes, the entropy, how much of the token the corpus' own words cover,
and how often the path, the words before and the word after go with secrets among the labelled findings.

The word list comes from the counts over all documents (its ``words`` most frequent ones); the forest
is fitted in numpy on a bounded number of the findings of all documents per label (``per_label``). Scanning and redaction read
whole texts where they are stored; nothing but counts and the training sample is moved.
"""

from __future__ import annotations

import heapq
import math
import re
import warnings
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import short_batches
from contactloom.session import cut_lineage

TOKEN = re.compile(r"[A-Za-z0-9+/_~\-]{12,}={0,2}")
WORD = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"[a-z]+")
AROUND = 48
#: how far before a finding its label looks
BEFORE = 96
#: every alternative starts with a letter or sign of its own, which lets the search skip
FORMAT = re.compile(
    r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|ASIA[0-9A-Z]{16}(?![0-9A-Za-z])|AIza[\w-]{30,}"
    r"|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}|ghu_[A-Za-z0-9]{20,}|ghs_[A-Za-z0-9]{20,}|ghr_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}"
    r"|xox[a-z]-[A-Za-z0-9-]{10,}|xapp-[A-Za-z0-9-]{10,}"
    r"|sk_live_[A-Za-z0-9]{10,}|sk_test_[A-Za-z0-9]{10,}|rk_live_[A-Za-z0-9]{10,}|sk-(?=[\w-]{0,100}\d)[\w-]{20,}|SG\.[\w-]{16,100}\.[\w-]{16,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{40,}|ya29\.[\w-]{20,}"
    r"|(?<![\w-])eyJ[\w-]{8,}+(?:\.[\w-]+){1,4}={0,2}"
)
#: key blocks: their first and last lines, and what may follow a first line without a last one
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_LINES = re.compile(r"(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*")
#: the password of an address
LOGIN = re.compile(r"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
SIGN = re.compile(r"(?<![=!<>:])(?:=>|:=|[:=])(?![=:/])")
_NAME = (
    r"(?P<name>pass(?:word|wd|phrase|code)|(?<![a-z0-9])pass(?![a-z0-9])|pwd|secret|token|credential|authorization|api[_.\- ]?key"
    r"|(?:access|private|auth|encryption|signing|account|shared|client|master|session|storage|service|deploy)[_.\- ]?key"
    r"|(?<!public)(?<!primary)(?<!foreign)(?<!partition)(?<!sort)[_-]key)"
    r"(?!i[sz]|s(?![a-z0-9]))(?P<rest>[\w.\-]{0,40})(?:\s{0,4}:\s{0,4}[A-Za-z]{1,20}(?=\s{0,4}=))?"
)
NAMED = re.compile(_NAME + r"(?P<close>\\?[\"'`\]]{0,2})\s{0,8}(?P<sign>=>|:=|[:=])$", re.I)
_SCHEME = r"(?:(?:Bearer|Basic|Token|Digest)\s{1,4})?"
VALUE = re.compile(rf"\s{{0,8}}(?:\\([\"'`]){_SCHEME}(?P<escaped>[^\n]+?)\\\1|([\"'`]){_SCHEME}(?P<quoted>(?:\\.|(?!\3)[^\\\n])+)\3|\\?[\"'`]?{_SCHEME}(?![{{\[(])(?P<plain>(?:(?!&[\w.\-]+=)[^\s\"'`<>,;])+))", re.I)
ASSIGNED = re.compile(_NAME + rf"\\?[\"'`\]]{{0,2}}\s{{0,8}}(?P<sign>=>|:=|[:=])(?P<gap>\s{{0,8}})(?P<quote>\\?[\"'`]?){_SCHEME}$", re.I)
BEARER = re.compile(r"\bBearer\s{1,4}$", re.I)
#: names that tell about a secret instead of holding one
ABOUT = re.compile(r"(?:count|len|length|size|limit|file|path|url|uri|name|type|id|policy|field|hint|expir\w*|ttl)$", re.I)
#: values that stand for one
STAND_IN = re.compile(r"[xX*.•_\-?]+|[<\[{$%].*|null|none|nil|true|false|undefined|change.?me|example.*|your.*|todo|redacted|(?:os|self|this|process|config|settings|env)\.\w.*|[A-Za-z_][\w.]*[(\[].*", re.S)
#: words, numbers and what is put together from them
ORDINARY = re.compile(r"(?:[A-Za-z][a-z]{2,}|[A-Z]{3,}|\d+|[_/+~=\-])+")
DIGEST = re.compile(r"(?:commit|revision|rev|blob|tree|sha-?\d*|md5|etag|checksum|digest|integrity)\W{1,4}$", re.I)
HEX = re.compile(r"[0-9a-f]{12,}", re.I)


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Spans of private keys of any length: up to their last line if it comes before another block, else as far as key lines follow."""
    begins = list(KEY_BEGIN.finditer(text))
    ends = [m.span() for m in KEY_END.finditer(text)] if begins else []
    spans, at = [], 0
    for m in begins:
        while at < len(ends) and ends[at][0] < m.end():
            at += 1
        other = text.find("-----BEGIN ", m.end())
        whole = at < len(ends) and (other < 0 or ends[at][0] < other)
        spans.append((m.start(), ends[at][1] if whole else KEY_LINES.match(text, m.end()).end()))
    return spans


def found_tokens(text: str):
    """(start, end) of every candidate, in order, none overlapping another."""
    known = [m.span() for m in FORMAT.finditer(text) if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"))]
    known += [m.span(1) for m in LOGIN.finditer(text)] + key_blocks(text)
    until = 0
    for m in SIGN.finditer(text):
        if m.start() < until:  # inside a value
            continue
        name = NAMED.search(text[max(0, m.start() - BEFORE) : m.end()])
        if name and not ABOUT.search(name["rest"]) and (value := VALUE.match(text, m.end())):
            s, e = value.span(value.lastgroup)
            if value.lastgroup == "plain":
                while e > s and text[e - 1] in ")]}.":
                    e -= 1
            if e > s:
                known.append((s, e))
                until = e
    spans: list[list[int]] = []
    for s, e in sorted(known):
        if spans and s < spans[-1][1]:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    at = 0
    for m in TOKEN.finditer(text):
        s, e = m.span()
        token = m.group()
        while at < len(spans) and spans[at][1] <= s:
            yield tuple(spans[at])
            at += 1
        if (at == len(spans) or spans[at][0] >= e) and (any(map(str.isdigit, token)) or (token.isupper() and len(token) >= 16)):
            yield s, e
    yield from map(tuple, spans[at:])


def labelled_by_format(token: str, before: str) -> int | None:
    """1 for a secret, 0 for a false alarm, None if neither is clear."""
    if FORMAT.fullmatch(token) or KEY_BEGIN.match(token) or LOGIN.search(f"{before}{token}@", max(0, len(before) - BEFORE)) and re.search(r"://[^\s/:@\"'<>]*:$", before):
        return 1
    m = ASSIGNED.search(before)
    if m and not ABOUT.search(m["rest"]):
        digit = any(map(str.isdigit, token))
        if STAND_IN.fullmatch(token):
            return None
        if m["name"].lower() in ("_key", "-key") and not (digit and len(token) >= 12):
            return None
        if any(map(str.isspace, token)):
            return 1 if m["quote"] and m["sign"] != ":" and m["name"].lower().startswith("pass") else None
        if m["quote"] or digit or (m["sign"] == "=" and not m["gap"]):
            return 1
        # a word after a colon or a blank may be prose or code
        return 1 if len(token) >= 6 and (re.search(r"[!@#$%^&*?+~]", token) or re.search(r"[a-z][A-Z].*[a-z][A-Z]", token)) else None
    if BEARER.search(before) and len(token) >= 16:
        return 1
    if ORDINARY.fullmatch(token) or (DIGEST.search(before) and HEX.fullmatch(token)):
        return 0
    return None


def covered(token: str, words: frozenset[str]) -> float:
    """Greatest share of the token's characters that words of the list, of three letters or more, can cover."""
    total = 0
    for run in RUN.findall(token.lower()):
        best = [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            best[end] = max([best[end - 1], *(best[end - n] + n for n in range(3, min(end, 12) + 1) if run[end - n : end] in words)])
        total += best[-1]
    return total / len(token)


def shape(token: str) -> list[float]:
    """Length, entropy, shares of character classes and of the transitions between them."""
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in token]
    n, pairs = len(token), Counter(zip(kinds, kinds[1:], strict=False))
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(token).values())
    hexadecimal = sum(c in "0123456789abcdef" for c in token) / n
    moves = [pairs["l", "l"], pairs["u", "u"], pairs["d", "d"], pairs["l", "d"] + pairs["d", "l"], pairs["u", "d"] + pairs["d", "u"], pairs["l", "u"] + pairs["u", "l"]]
    return [float(min(n, 512)), entropy, hexadecimal, *(kinds.count(k) / n for k in "luo"), *(m / max(1, n - 1) for m in moves)]


def context(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The two words before a token, the nearer one first, and the word after it; empty where there is none."""
    before = WORD.findall(text[max(0, start - AROUND) : start].lower())
    after = WORD.findall(text[end : end + AROUND].lower())
    return (before[-1] if before else "", before[-2] if len(before) > 1 else "", after[0] if after else "")


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, left, right, value."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 7, seed: int = 11) -> Forest:
        rng, forest, width = np.random.default_rng(seed), cls(), max(1, int(np.sqrt(x.shape[1])) + 1)

        def grow(rows: np.ndarray, level: int, nodes: list) -> int:
            at = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, share])
            if level == depth or len(rows) < 4 or share in (0.0, 1.0):
                return at
            best = (share * (1 - share) - 1e-9, None, None)
            for f in rng.choice(x.shape[1], width, replace=False):
                column = x[rows, f]
                for cut in np.unique(np.quantile(column, np.linspace(0.05, 0.95, 12))):
                    left = column <= cut
                    if 0 < left.sum() < len(rows):
                        a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                        gini = left.mean() * a * (1 - a) + (1 - left.mean()) * b * (1 - b)
                        if gini < best[0]:
                            best = (gini, f, cut)
            if best[1] is not None:
                left = x[rows, best[1]] <= best[2]
                nodes[at][:2] = [int(best[1]), float(best[2])]
                nodes[at][2] = grow(rows[left], level + 1, nodes)
                nodes[at][3] = grow(rows[~left], level + 1, nodes)
            return at

        # a tree draws as many rows of each label: a rare one counts as much
        sides = [side for side in (np.flatnonzero(y == 0), np.flatnonzero(y == 1)) if len(side)]
        for _ in range(trees):
            nodes: list = []
            grow(np.concatenate([rng.choice(side, -(-len(y) // len(sides))) for side in sides]), 0, nodes)
            forest.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return forest

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (inner := feature[at] >= 0).any():
                here = at[inner]
                at[inner] = np.where(x[inner, feature[here]] <= threshold[here], left[here], right[here])
            total += value[at]
        return total / max(1, len(self.trees))


@dataclass
class Scanner:
    words: frozenset[str]
    odds: list[dict[str, float]]
    forest: Forest
    #: tells what taught the forest; it decides nothing
    label: Callable[[str, str], int | None] | None = None

    def features(self, token: str, around: tuple[str, str, str], path: str) -> list[float]:
        known = [o.get(v, 0.0) for o, v in zip(self.odds, (*around, path), strict=True)]
        return [*shape(token), covered(token, self.words), *known]

    def labelled(self, text: str, start: int, end: int) -> int | None:
        return None if self.label is None else self.label(text[start:end], text[max(0, start - BEFORE) : start])

    def scan(self, text: str, path: str) -> list[tuple[int, int, float]]:
        """(start, end, score of the forest) of every candidate of a whole text."""
        spans = list(found_tokens(text))
        if not spans:
            return []
        x = np.array([self.features(text[s:e], context(text, s, e), path) for s, e in spans])
        return [(s, e, p) for (s, e), p in zip(spans, self.forest.score(x).tolist(), strict=True)]


def frequent_words(docs: DataFrame, text: str, words: int) -> frozenset[str]:
    """The ``words`` most frequent words of three letters or more over all documents (ties by the word)."""

    def told(seen: Counter):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                value = x.as_py()
                if value is not None:
                    seen.update(value.lower().split())
                if len(seen) > 100_000:  # bounded memory; the sums below put the parts together
                    yield told(seen)
                    seen = Counter()
        yield told(seen)

    counts = docs.select(text).mapInArrow(count, "word string, n long").where(r"word rlike '^\\p{L}{3,}$'")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return frozenset(r["word"] for r in top.collect())


def train(docs: DataFrame, text: str = "text", path: str = "source", key: str = "doc_id", label: Callable[[str, str], int | None] = labelled_by_format, words: int = 5000, per_label: int = 1500) -> Scanner:
    """A scanner from findings labelled by ``label(token, text before it)`` (1 secret, 0 false alarm, None unclear).

    Findings of all documents are labelled; those of the ``per_label`` lowest draws of each label teach the forest, so
    that a rare label is seen however large the table is. A label that no finding of the table has is warned of:
    without findings, or with one label only, the forest gives every candidate the score 0 or that label.
    """
    short_batches(docs.sparkSession)
    vocabulary = frequent_words(docs, text, words)
    own = docs.select(text, F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.xxhash64(key, text).alias("draw"))

    def label_all(frames):
        kept: dict[int, list[tuple]] = {0: [], 1: []}
        for frame in frames:
            for x, where, draw in zip(frame[text], frame["path"], frame["draw"], strict=True):
                if isinstance(x, str):
                    for s, e in found_tokens(x):
                        y = label(x[s:e], x[max(0, s - BEFORE) : s])
                        if y is not None:
                            kept[y].append((y, draw, s, x[s:e], *context(x, s, e), where))
            for y, some in kept.items():  # what a task passes on is bounded
                if len(some) > per_label:
                    kept[y] = heapq.nsmallest(per_label, some)
        yield pd.DataFrame(kept[0] + kept[1], columns=["label", "draw", "start", "token", "near", "far", "after", "path"])

    # written, so that texts are read once for both labels
    findings = cut_lineage(own.mapInPandas(label_all, "label int, draw long, start long, token string, near string, far string, after string, path string"))
    keep = [findings.where(F.col("label") == y).orderBy("draw", "start", "token", "path").limit(per_label) for y in (0, 1)]
    rows = keep[0].unionByName(keep[1]).toPandas().sort_values(["label", "draw", "start", "token", "path"], kind="stable")
    missing = [name for y, name in enumerate(("false alarm", "secret")) if not (rows["label"] == y).any()]
    if missing:
        warnings.warn(f"no finding of the whole table is labelled {' or '.join(missing)}", stacklevel=2)
    if not len(rows):
        return Scanner(vocabulary, [{}] * 4, Forest(), label)
    y = rows["label"].to_numpy()
    odds = []
    for column in ("near", "far", "after", "path"):
        table = rows.groupby(column)["label"].agg(["sum", "count"])
        # a word seen once says little: two imagined findings of either label stand against it
        odds.append({w: float(np.log((s + 2) / (n - s + 2))) for w, s, n in zip(table.index, table["sum"], table["count"], strict=True) if n >= 3})
    scanner = Scanner(vocabulary, odds, Forest(), label)
    x = np.array([scanner.features(t, (a, b, c), p) for t, a, b, c, p in rows[["token", "near", "far", "after", "path"]].itertuples(index=False)])
    scanner.forest = Forest.fit(x, y)
    return scanner


def scan(docs: DataFrame, scanner: Scanner, text: str = "text", path: str = "source", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, secret, score, label) of the candidates to which the forest gives a score of ``threshold`` or more.

    ``label`` is what formats and assignments say of a finding (1, 0, or null); it doesn't change the decision. Offsets count code points. Null or empty texts have no findings; a null path counts as empty; a null id
    stays null; repeated rows are reported each; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # word list and trees: bounded by their parameters

    def run(frames):
        for frame in frames:
            rows = [
                (doc, s, e, x[s:e], score, shared.value.labelled(x, s, e))
                for doc, x, where in zip(frame["doc_id"], frame["text"], frame["path"], strict=True)
                for s, e, score in shared.value.scan(x, where)
                if score >= threshold
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "secret", "score", "label"]).astype({"doc_id": "Int64", "label": "Int64"})

    return inputs(docs, text, path, key).mapInPandas(run, "doc_id long, start long, end long, secret string, score double, label long")


def inputs(docs: DataFrame, text: str, path: str, key: str) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, empty).alias("text"), F.coalesce(F.col(path).cast("string"), empty).alias("path"))


def redact(docs: DataFrame, scanner: Scanner, text: str = "text", path: str = "source", threshold: float = 0.5, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; rows, columns and null texts stay."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    at, where_at = docs.columns.index(text), docs.columns.index(path)

    def clean(x: str | None, where) -> str | None:
        if x is not None:
            for s, e, score in reversed(shared.value.scan(x, "" if where is None else str(where))):
                if score >= threshold:
                    x = x[:s] + mark + x[e:]
        return x

    def run(batches):
        for batch in batches:
            new = [clean(x.as_py(), w.as_py()) for x, w in zip(batch.column(at), batch.column(where_at), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
