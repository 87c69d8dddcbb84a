"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans: email, ip, card, phone. The field then adds later (or earlier) mentions that no pattern
fits, such as the local part of an address, the last digits of a card or a phone number without its country code. Its
nodes are a document's words that hold a digit or an at sign, and the words that equal the local part of an observed
address; other words are fixed to "other", so the graph falls apart there. Edges (``EDGES``):

- chain: words that follow each other;
- same: words that are alike but for case and signs at their ends;
- tail: numbers whose last seven digits agree;  groups: four numbers that agree, whatever stands between them;
- local: the local part of an address, if it holds a digit or a sign;  name: if it is of letters alone (an everyday word, maybe);
- masked: four last digits behind signs that hide the others, last4: four digits, each as the end of a card number.

Words under a base span are observed. A word meets the word before it that is the same, and a word like an observed
mention as a whole (its last word bears the mention's keys) the nearest such mention before it, else behind it, wherever
these stand; so edges grow with the words, and no word without a mention in its document vouches for another. Loopy
sum-product messages (damped, at most ``ROUNDS``) give each word's marginals; an unobserved word whose kind has
``SURE`` or more of the mass is added, adjoining words of a kind as one span. Base spans always stay as they are.

Node weights and the edges' tables are trained together, by the pseudo-likelihood of unobserved words given their
neighbours' labels. No table names later mentions, so they are planted: to a text of the sample that holds base spans,
one of each kind is added again in a form that no pattern fits, and the same form of another number, twice, as "other"; all
other words without a base span are "other" too. The sample has about ``SAMPLE_DOCS`` documents, drawn by a hash of
their id; Spark adds it up to counts of equal words (features, neighbours, label).
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import drawn, map_batches, slices, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE_DOCS = 20_000
ROUNDS, DAMPING, SURE = 12, 0.3, 0.9
EDGES = ("chain", "tail", "groups", "local", "name", "masked", "last4", "same")
SAME = len(EDGES) - 1

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]+")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_EDGE = ".,;:!?()[]{}<>\"'`*#$%&|/="
#: Cue words before a number, fixed values.
_CUES = {"email": ("email", "mail", "e-mail", "contact"), "ip": ("ip", "host", "address"), "card": ("card", "visa", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax")}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws}
_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_MASK = re.compile(r"[*xX#•]{2,}[*xX#•-]*[0-9]{4}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping per kind, by start and then by kind as listed.

    Each pattern is searched in time linear in the text.
    """
    out: list[tuple[int, int, int]] = []
    last = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                last = m.end()
    digits = False
    for m in _DOTTED.finditer(text):
        digits = True
        if "." in m.group():
            parts = [(p.start(), p.end()) for p in _PART.finditer(text, m.start(), m.end())]
            for i in range(0, len(parts) - 3, 4):
                if all(e - s < 4 or not text[s:e].lstrip("0")[3:] for s, e in parts[i : i + 4]) and all(int(text[s:e].lstrip("0") or "0") <= 255 for s, e in parts[i : i + 4]):
                    out.append((parts[i][0], 1, parts[i + 3][1]))
    if digits:
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                found = re.sub("[ -]", "", m.group())
                if 12 <= len(found) <= 19 and luhn(found):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def candidate_words(text: str) -> list[tuple[int, int, int, int]]:
    """(word start, word end, core start, core end) of the words with a digit or an at sign; the core lacks signs at the ends."""
    out, upto = [], 0
    n = len(text)
    for m in _HIT.finditer(text):
        if m.start() < upto:
            continue
        s, e = m.start(), m.end()
        while s > upto and text[s - 1] not in _SPACE:
            s -= 1
        while e < n and text[e] not in _SPACE:
            e += 1
        cs, ce = s, e
        while cs < ce and text[cs] in _EDGE:
            cs += 1
        while ce > cs and text[ce - 1] in _EDGE:
            ce -= 1
        if cs > s and text[cs - 1] == "(" and ")" in text[cs:e]:  # a bracketed code keeps its brackets
            cs, ce = cs - 1, max(ce, text.rindex(")", cs, e) + 1)
        if cs < ce:
            out.append((s, e, cs, ce))
        upto = e
    return out


DIGITS = (0, 1, 4, 5, 7, 8, 10, 11, 12, 16, 17, 20)
FEATURES = ("bias", "at", "at_dot", "plus", "paren", "hyphen", "letters", "plain", "joined", "masked", "dots1", "dots3", "luhn", "groups", *(f"digits{k}" for k in DIGITS), *(f"cue_{k}" for k in KINDS))
_PLACE = {f: i for i, f in enumerate(FEATURES)}


def _digits(text: str) -> str:
    return "".join(_PART.findall(text))


def _groups(core: str) -> str | None:
    """Four numbers up to 255, joined by dots, of a word that holds just four."""
    found = _PART.findall(core)
    if len(found) == 4 and all(len(x) < 4 and int(x) < 256 for x in found):
        return ".".join(str(int(x)) for x in found)
    return None


def local_key(local: str) -> tuple[str, str] | None:
    """Edge and key of an address's local part."""
    local = local.lower().strip("._%+-")
    if not local:
        return None
    return ("name" if local.isalpha() or len(local) < 4 else "local"), local


def word_features(text: str, word: tuple[int, int, int, int]) -> tuple[int, ...]:
    """Indexes into FEATURES that hold for a word."""
    s, _, cs, ce = word
    core = text[cs:ce]
    digits = _digits(core)
    n = len(digits)
    has = ["bias"]
    if "@" in core:
        has.append("at_dot" if _DOMAIN.search(core) else "at")
    elif not n:
        has.append("plain" if core.isalpha() else "joined")
    dots = core.count(".")
    letters = any(c.isalpha() for c in core)
    for name, there in (("plus", core[0] == "+"), ("paren", "(" in core), ("hyphen", "-" in core), ("letters", letters), ("masked", n == 4 and _MASK.search(core) is not None), ("dots1", 0 < dots < 3), ("dots3", dots == 3), ("luhn", 12 <= n <= 19 and luhn(digits)), ("groups", not letters and _groups(core) is not None)):
        if there:
            has.append(name)
    has.append(f"digits{max(k for k in DIGITS if n >= k)}")
    before = text[max(0, s - 24) : s].split()
    if before and (cue := _CUE_OF.get(before[-1].lower().strip(_EDGE))):
        has.append(f"cue_{cue}")
    return tuple(sorted(_PLACE[f] for f in has))


def word_keys(core: str) -> list[tuple[str, str]]:
    """Edges and keys of a word by itself, which link it with mentions that have one of them."""
    digits, out = _digits(core), []
    if len(digits) >= 7:
        out.append(("tail", digits[-7:]))
    if groups := _groups(core):
        out.append(("groups", groups))
    if "@" in core:
        if key := local_key(core.split("@")[0]):
            out.append(key)
    if len(digits) == 4:
        if core == digits:
            out.append(("last4", digits))
        elif _MASK.search(core):
            out.append(("masked", digits))
    return out


def span_keys(kind: str, mention: str) -> list[tuple[str, str]]:
    """Edges and keys of an observed mention as a whole."""
    if kind == "email":
        key = local_key(mention.split("@")[0])
        return [key] if key else []
    if kind == "ip":
        return [("groups", ".".join(x.lstrip("0") or "0" for x in mention.split(".")))]
    digits = _digits(mention)
    return [("tail", digits[-7:])] + ([("masked", digits[-4:]), ("last4", digits[-4:])] if kind == "card" else [])


def named_words(text: str, names: set[str]) -> list[tuple[int, int, int, int]]:
    """The words without a digit or an at sign that equal a local part but for case, signs at the ends and a genitive."""
    out = []
    for m in _WORDS.finditer(text):
        core = m.group().strip(_EDGE)
        bare = core[:-2] if core[-2:].lower() in ("'s", "’s") else core
        if bare.lower().strip("._%+-") in names and not _HIT.search(bare):
            cs = m.start() + m.group().index(core)
            out.append((m.start(), m.end(), cs, cs + len(bare)))
    return out


def graph(text: str, spans: list[tuple[int, str, int]]) -> tuple[list, np.ndarray, list[tuple[int, int]], list[int]]:
    """Words, their observed labels (-1: none), edges (pairs of words), and each edge's place in EDGES."""
    words = candidate_words(text)
    for k, (s, e, cs, ce) in enumerate(words):
        if ce - cs == 4 and cs > s and (m := _MASK.search(text, s, ce)):
            words[k] = (s, e, m.start(), ce)  # the signs that hide digits belong to the mention
    names = {key[1] for start, kind, end in spans if kind == "email" and (key := local_key(text[start:end].split("@")[0]))}
    if names:
        words = sorted([*words, *named_words(text, names)])
    seen = np.full(len(words), -1)
    keys: list[list] = [[] for _ in words]
    k = 0
    for start, kind, end in spans:
        while k and words[k - 1][1] > start:
            k -= 1
        while k < len(words) and words[k][1] <= start:
            k += 1
        i = k
        while i < len(words) and words[i][2] < end:
            if words[i][3] > start:
                if seen[i] < 0:
                    seen[i] = LABELS.index(kind)
                if i + 1 == len(words) or words[i + 1][2] >= end:
                    keys[i] += span_keys(kind, text[start:end])
            i += 1
    kind_of: dict[tuple[int, int], int] = {}
    for i in range(len(words) - 1):
        if words[i + 1][0] - words[i][1] <= 2 and not text[words[i][1] : words[i + 1][0]].strip():
            kind_of[i, i + 1] = 0
    # words like a mention are linked with it: with the last one before, else the first one behind
    mentions: dict[tuple[str, str], list[int]] = {}
    for i, found in enumerate(keys):
        for key in found:
            mentions.setdefault(key, []).append(i)
    last: dict[str, int] = {}
    for i, (_, _, cs, ce) in enumerate(words):
        core = text[cs:ce]
        if mentions and seen[i] < 0:
            own = word_keys(core)
            if names and "@" not in core and (key := local_key(core)):
                own.append(key)
            for key in own:
                if at := mentions.get(key):
                    j = at[max(bisect.bisect(at, i) - 1, 0)]
                    kind_of.setdefault((min(i, j), max(i, j)), EDGES.index(key[0]))
        before = last.get(core.lower())
        if before is not None:
            kind_of.setdefault((before, i), SAME)
        last[core.lower()] = i
    return words, seen, list(kind_of), list(kind_of.values())


def messages(unary: np.ndarray, edges: list[tuple[int, int]], tables: np.ndarray) -> np.ndarray:
    """Marginals by damped sum-product; ``tables`` has the log potential of each edge, indexed by the labels of its two ends."""
    n, labels = unary.shape
    if edges:
        ends = np.array(edges)
        src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        pot = np.concatenate([tables, tables.transpose(0, 2, 1)])
        m, back = len(edges), np.roll(np.arange(2 * len(edges)), len(edges))
        msg = np.full((2 * m, labels), -np.log(labels))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + pot
            top = out.max(axis=1, keepdims=True)
            new = (np.log(np.exp(out - top).sum(axis=1, keepdims=True)) + top)[:, 0, :]
            new -= np.log(np.exp(new - new.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + new.max(axis=1, keepdims=True)
            new = DAMPING * msg + (1 - DAMPING) * new
            change = np.abs(new - msg).max()
            msg = new
            if change < 1e-4:
                break
        unary = unary.copy()
        np.add.at(unary, dst, msg)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find_spans(text: str | None, model: dict) -> tuple[list, list]:
    """(base spans, added spans) of a text; a null text has none."""
    text = text or ""
    if not _HIT.search(text):
        return [], []
    base = base_spans(text)
    words, seen, edges, kinds = graph(text, base)
    if (seen >= 0).all():
        return base, []
    unary = np.array([model["node"][:, list(word_features(text, w))].sum(axis=1) for w in words])
    for i in np.flatnonzero(seen >= 0):
        unary[i] = -1e3
        unary[i, seen[i]] = 0
    p = messages(unary, edges, model["edge"][kinds])
    label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    added: list[tuple[int, str, int]] = []
    joined = {j for (_, j), kind in zip(edges, kinds) if not kind}
    for i, (_, _, cs, ce) in enumerate(words):
        if seen[i] < 0 and label[i] > 0:
            kind = LABELS[label[i]]
            if added and i in joined and seen[i - 1] < 0 and label[i - 1] == label[i]:
                added[-1] = (added[-1][0], kind, ce)
            else:
                added.append((cs, kind, ce))
    return base, added


# Training


def later_form(kind: str, mention: str, turn: int) -> tuple[str, str]:
    """(words before, mention) of a later mention that no pattern fits; ``turn`` picks the form."""
    digits = _digits(mention)
    if kind == "email":
        local, domain = mention.split("@", 1)
        forms = [f"{local}@{domain.split('.')[0]}"]
        if (key := local_key(local)) and key[0] == "local":
            forms += [local, local.capitalize(), local]
        return "by", forms[turn % len(forms)]
    if kind == "ip":
        parts = mention.split(".")
        return "on", ("-".join(parts), "[.]".join(parts), "ip-" + "-".join(parts), "_".join(parts))[turn % 4]
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [("no", ".".join(fours)), ("no", "/".join(fours)), ("no", "****" + digits[-4:]), ("no", "xxxx-xxxx-xxxx-" + digits[-4:]), ("card ending in", digits[-4:])][turn % 5]
    area, rest = digits[-10:-7], f"{digits[-7:-4]}-{digits[-4:]}"
    return "at", (f"({area}) {rest}", f"{area}.{rest.replace('-', '.')}", f"{area}-{rest}", rest, digits[-10:], digits)[turn % 6]


def decoy_of(mention: str) -> str:
    """Another mention of the same shape."""
    change = {str(d): str((d * 7 + 3) % 10) for d in range(10)}
    local, at, domain = mention.partition("@")
    return "".join(change.get(c, c) for c in mention) if not at else f"{local[::-1]}q@{domain}"


def planted(text: str, spans: list[tuple[int, str, int]]) -> tuple[str, list[tuple[int, str, int]]]:
    """The text with a later mention of the first span of each kind, and a decoy, added; and the added mentions.

    A phone number is added once more as another one written without signs, with a later mention: these share no word.
    """
    out, where, done = [text], [], set()
    size = len(text)

    def add(kind: str, mention: str, turn: int, lead: str) -> None:
        nonlocal size
        before, form = later_form(kind, mention, turn)
        lead = f"\n{lead} {before} "
        where.append((size + len(lead), kind, size + len(lead) + len(form)))
        decoy = " ".join(later_form(kind, decoy_of(mention), turn))
        out.append(f"{lead}{form} again, and {decoy} too, {decoy} twice")
        size += len(out[-1])

    for start, kind, end in spans:
        if kind not in done and (kind != "phone" or len(_digits(text[start:end])) >= 10):
            done.add(kind)
            mention = text[start:end]
            turn = zlib.crc32(mention.encode())
            add(kind, mention, turn, "later")
            if kind == "phone":
                other = "+" + _digits(decoy_of(decoy_of(mention)))
                add(kind, other, turn // 6, f"or {other} then")
    return "".join(out), where


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and _HIT.search(text):
                text, later = planted(text, base_spans(text))
                words, seen, edges, kinds = graph(text, base_spans(text))
                label = np.maximum(seen, 0)
                for i, (_, _, cs, ce) in enumerate(words):
                    for start, kind, end in later:
                        if seen[i] < 0 and cs < end and ce > start:
                            label[i] = LABELS.index(kind)
                met: list[Counter] = [Counter() for _ in words]
                for (i, j), kind in zip(edges, kinds):
                    met[i][kind * len(LABELS) + int(label[j])] += 1
                    met[j][kind * len(LABELS) + int(label[i])] += 1
                for i, w in enumerate(words):
                    if seen[i] < 0:
                        count[" ".join(map(str, word_features(text, w))), " ".join(f"{k}:{n}" for k, n in sorted(met[i].items())), int(label[i])] += 1
    features, met_, label_ = zip(*count) if count else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array(met_, pa.string()), pa.array(label_, pa.int64()), pa.array(list(count.values()), pa.int64())], names=["features", "met", "label", "n"])


#: What a field knows without any text: shapes alone are nothing, a link with a mention of its kind is.
PROTOTYPES = [("letters digits20", "", 0), ("digits16", "", 0), ("hyphen digits7", "", 0), ("digits1", "", 0), ("digits4", "", 0), ("dots1 digits1", "", 0), ("plain digits0", "name email", 0), ("joined digits0", "local email", 1), ("groups hyphen digits4", "groups ip", 2), ("luhn digits16 dots3", "tail card", 3), ("masked digits4", "masked card", 3), ("hyphen digits7", "tail phone", 4)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Node weights (label by feature) and edge tables (edge by label by label), from about ``sample_docs`` documents (at most twice as many).

    They are drawn by a hash of id and text, so ids that repeat or are null neither empty nor flood the sample; where rows
    are drawn, those that repeat count once. Null and empty texts teach nothing; an empty table leaves the prototypes alone.
    """
    sample = drawn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id", "text"], sample_docs).select("text")
    rows = map_batches(sample, _statistics, "features string, met string, label long, n long").groupBy("features", "met", "label").agg(F.sum("n").alias("n")).orderBy("features", "met", "label").collect()
    places = [([_PLACE[f] for f in ["bias", *names.split()]], [(EDGES.index(met.split()[0]) * len(LABELS) + LABELS.index(met.split()[1]), 1)] if met else [], y, 1) for names, met, y in PROTOTYPES]
    places += [([int(i) for i in r["features"].split()], [tuple(map(int, x.split(":"))) for x in r["met"].split()], r["label"], r["n"]) for r in rows]
    x, met = np.zeros((len(places), len(FEATURES))), np.zeros((len(places), len(EDGES) * len(LABELS)))
    for k, (found, near, _, _) in enumerate(places):
        x[k, found] = 1
        for place, n in near:
            met[k, place] = n
    y = np.eye(len(LABELS))[[p[2] for p in places]]
    n = np.array([float(p[3]) for p in places])
    n = n[:, None] / n.sum()
    node, edge = np.zeros((len(FEATURES), len(LABELS))), np.zeros((len(EDGES), len(LABELS), len(LABELS)))
    square = edge.shape
    state = [np.zeros_like(node), np.zeros_like(node), np.zeros_like(edge), np.zeros_like(edge)]
    for step in range(1, 1501):  # gradient steps of adaptive size; the tables stay symmetric
        z = x @ node + met @ edge.reshape(-1, len(LABELS))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = n * (p / p.sum(axis=1, keepdims=True) - y)
        slope = (met.T @ off).reshape(square)
        for k, (weights, grad) in enumerate(((node, x.T @ off + 1e-6 * node), (edge, (slope + slope.transpose(0, 2, 1)) / 2 + 1e-6 * edge))):
            mean, size = state[2 * k], state[2 * k + 1]
            mean += 0.1 * (grad - mean)
            size += 0.01 * (grad * grad - size)
            weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-9)
    return {"node": node.T, "edge": edge}


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))


def detect(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans, n_added and n_spans (of all) of every row.

    A null or empty text has no spans. Of spans that begin together the kind listed first comes first. Rows that repeat are
    searched alike; an empty table gives no rows. Texts are searched whole; other columns are not read.
    """
    arrow = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    base, added = find_spans(text, model)
                    each = Counter(k for _, k, _ in base)
                    rows.append((*(each[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added), len(base) + len(added)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:]))], schema=arrow)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``documents`` with each span replaced by its kind in brackets, overlapping spans by that of the first, and n_chars recounted.

    Texts without a span stay as they are, null ones null; of spans that begin together the kind listed first names
    them. Rows that repeat are treated alike and all stay; an empty table gives none. Other columns are dropped.
    """
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out, sizes = [], []
                for text, size in zip(part.column(1).to_pylist(), part.column(4).to_pylist()):
                    base, added = find_spans(text, model)
                    if base or added:
                        bits, at = [], 0
                        for s, k, e in sorted(base + added, key=lambda x: (x[0], KINDS.index(x[1]))):
                            if s >= at:
                                bits += [text[at:s], f"[{k.upper()}]"]
                            at = max(at, e)
                        text = "".join([*bits, text[at:]])
                        size = len(text)
                    out.append(text), sizes.append(size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), part.column(2), part.column(3), pa.array(sizes, pa.int64())], names=part.schema.names)

    return map_batches(rows, run, "doc_id long, text string, lang string, source string, n_chars long")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(docs))
