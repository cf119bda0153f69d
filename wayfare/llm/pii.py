"""Personal data by exact patterns and a skip-chain conditional random field.

Base spans come from four patterns with checks (octets, Luhn, digit counts). The field adds what they miss by
consistency: its nodes are the words of a text that have a digit or an ``@``; runs of such words whose digits, joined, end like those of a phone or card
base span of the text (or the other way round), each run one node; and words that, without case and punctuation, equal the local part (of more than three
characters) of an e-mail base span of the text. Of the last only far links tell; the names of roles (``ROLES``) and plain words that several
documents have, counted over all of them, are no such mentions, unless joined by a dot, underscore or hyphen. All other words are plain.

Neighbouring nodes are linked by learned transitions, and however far apart, nodes that are equal or similar (the same last seven digits, or the
local part of an address) share a potential for having one label. Nodes in base spans are observed; loopy belief
propagation gives the others their label probabilities: each round sweeps every row of linked words forwards and backwards,
so that a base span reaches all of its row at once, until the messages of the document settle. Runs of neighbouring nodes of one kind at ``CONFIDENCE`` or more
are added if links of equality or similarity tie one of them to a base span of that kind.

The field is trained by pseudo-likelihood on a bounded sample, about ``SAMPLE`` documents with such words, labelled by the
base spans, and features are dropped at random. The potentials of far links are learned with the rest: to the sampled texts that have a phone,
card or address a repetition is added in a form that the patterns miss, labelled as what it repeats, so that only the link tells.
Occurrences of one word are linked in a row, not in pairs, and when spans are sought each
one also to a base span of its row, so that small doubts do not add up along it. Spans are sought in whole documents, without a shuffle.

NULL texts are empty and have no spans. Repeated rows get equal results. Without any training document only base
spans are found. Offsets are code points, ends exclusive. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.language import BLOCK, block_messages, marginals
from wayfare.llm.lean import lean

# The kinds and their order, and the patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_NODE = re.compile(r"[^\s0-9@]*[0-9@]\S*")
_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[+(]*[0-9][0-9().-]*[.,;:!?]*")
_JOINED = re.compile(r"\w[._-]\w")
_TRIM = ".,;:!?()[]<>\"'|#$%&*"
BUCKETS = 1 << 14
SAMPLE = 2000
CONFIDENCE = 0.9
ROUNDS = 200
FREE = 20
SETTLED = 1e-4
# Where far links' potentials start from, and how fast they are learned beside the others.
SHARED = 1.0
SHARED_RATE = 1.0
# A plain word in so many documents, and in this share of them, is no name.
COMMON, COMMON_SHARE = 2, 0.001
# Mailbox names of roles, not of persons.
ROLES = frozenset(
    """abuse account accounts admin administrator alert alerts billing booking bookings careers contact customer customers desk email enquiries
    feedback finance hello help helpdesk home hostmaster hotel info information inquiries invoice invoices jobs legal list lists mail mailer
    mailing manager marketing media member members news newsletter noreply notice office official online order orders payment payments people post
    postmaster press privacy public reception register registration reply reservation reservations root sales secretary security service
    services shop site spam staff store student students support team tech test ticket tickets user users webmaster website welcome work
    """.split()
)
_OBSERVED = 50.0
_LEAST = 200.0
_SEED = 20_24
LABELS = len(KINDS) + 1  # the last one is plain

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain. Searched from the @, as a local part is all that can stand before it."""
    end = 0
    for domain in _DOMAIN.finditer(text):
        begin = domain.start()
        while begin > end and (text[begin - 1].isalnum() and text[begin - 1].isascii() or text[begin - 1] in "._%+-"):
            begin -= 1
        if begin < domain.start():
            end = domain.end()
            yield begin, end


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


@dataclass
class Nodes:
    """The candidate words of texts laid end to end, with their links."""

    text: list[int]
    start: list[int]
    end: list[int]
    features: list[list[int]]
    next_to: list[tuple[int, int]]  # neighbours in the text
    equal: list[tuple[int, int]]
    similar: list[tuple[int, int]]
    labels: list[int]  # by the base spans
    bare: list[bool]  # without digit and @: a mention, which only far links tell of
    equal_base: list[tuple[int, int]]  # a word in a base span and an equal word further than its neighbour in the row
    similar_base: list[tuple[int, int]]


def _shape(word: str) -> str:
    out, last = [], ""
    for c in word[:40]:
        kind = "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


def _features(word: str, before: str, after: str) -> list[int]:
    digits = "".join(filter(str.isdigit, word))
    names = [
        f"shape {_shape(word)}", f"digits {min(len(digits), 20)}", f"first {word[0]}", f"dots {min(word.count('.'), 5)}",
        f"at {'@' in word}", f"letters {any(map(str.isalpha, word))}", f"before {before}", f"after {after}",
        f"digits {len(digits)} before {before}", f"digits {len(digits)} after {after}",
        f"card {14 <= len(digits) <= 19 and digits.isascii() and luhn(digits)}", "any",
    ]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def _plain(word: str) -> str:
    return word.strip(_TRIM).lower()


def _locals(text: str, own: list[Span]) -> dict[int, str]:
    """The local parts of the e-mail base spans, by where they start."""
    return {start: _plain(text[start:end].partition("@")[0]) for start, kind, end in own if KINDS[kind] == "email"}


def _nameable(word: str) -> bool:
    return len(word) > 3 and not _DIGIT.search(word) and any(map(str.isalpha, word))


def _mentions(text: str, wanted: set[str], common: frozenset[str]) -> list[tuple[int, int]]:
    """Words without a digit or an ``@`` that, normalised, are among ``wanted`` and look like part of a name."""
    wanted = {x for x in wanted if _nameable(x) and (_JOINED.search(x) or x not in ROLES and x not in common)}
    return [(m.start(), m.end()) for m in _WORD.finditer(text) if _plain(m.group()) in wanted and not _NODE.match(m.group())] if wanted else []


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _numbers(text: str, own: list[Span]) -> dict[int, str]:
    """The digits of the phone and card base spans, if seven or more, by where they end."""
    found = {end: _digits(text[start:end]) for start, kind, end in own if KINDS[kind] in ("card", "phone")}
    return {end: digits for end, digits in found.items() if len(digits) >= 7}


def _merged(text: str, found: list[tuple[int, int]], kinds: np.ndarray, numbers: list[str]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Words and kinds, with runs of words outside base spans that write one of ``numbers``, or its end, made one word each."""
    tails = defaultdict(list)
    for digits in numbers:
        tails[digits[-7:]].append(digits)
    out, labels, i = [], [], 0
    while i < len(found):
        written, last = "", i
        for j in range(i, len(found)):
            start, end = found[j]
            beside = j == i or not text[found[j - 1][1] : start].strip()
            if not beside or kinds[j] < LABELS - 1 or not _NUMBER.fullmatch(text, start, end):
                break
            written += _digits(text[start:end])
            if len(written) > 19:
                break
            if len(written) >= 7 and any(d.endswith(written) or written.endswith(d) for d in tails.get(written[-7:], ())):
                last = j
        out.append((found[i][0], found[last][1]))
        labels.append(kinds[i])
        i = last + 1
    return out, np.array(labels, np.int64)


def nodes_of(texts: list[str], spans: list[list[Span]], mentions: bool = False, common: frozenset[str] = frozenset()) -> Nodes:
    """The nodes of ``texts``; with ``mentions`` also those, and the links to base spans, that training leaves out."""
    nodes = Nodes(*([] for _ in range(11)))
    for number, (text, own) in enumerate(zip(texts, spans)):
        found = [(m.start(), m.end()) for m in _NODE.finditer(text)] if "@" in text or _DIGIT.search(text) else []
        kinds = np.zeros(0, np.int64)
        if found:
            begins = np.array([s for s, _ in found])
            kinds = np.full(len(found), LABELS - 1)
            for start, kind, end in reversed(own):
                low = np.searchsorted(begins, start, side="right") - 1
                high = np.searchsorted(begins, end)
                for i in range(max(low, 0), high):
                    if found[i][1] > start:
                        kinds[i] = kind
        numbers = _numbers(text, own) if found else {}
        if numbers:
            found, kinds = _merged(text, found, kinds, list(numbers.values()))
            begins = np.array([s for s, _ in found])
        # the last word of a number in a base span stands for all of it
        whole = {int(np.searchsorted(begins, end)) - 1: digits for end, digits in numbers.items()}
        parts = _locals(text, own) if mentions else {}
        named = [set() for _ in found]
        for start, part in parts.items():
            named[np.searchsorted(begins, start, side="right") - 1].add(part)
        wanted = {_plain(text[slice(*found[i])]).partition("@")[0] for i, own_parts in enumerate(named) if own_parts}
        bare = [(start, end, -1) for start, end in _mentions(text, wanted.union(parts.values()), common)]
        rows: dict[tuple[int, str], list[int]] = defaultdict(list)
        for start, end, i in sorted([(*place, i) for i, place in enumerate(found)] + bare):
            node, word = len(nodes.text), text[start:end]
            tied = i > 0 and not text[found[i - 1][1] : start].strip()
            follows = 0 <= i < len(found) - 1 and not text[end : found[i + 1][0]].strip()
            before = _shape(text[slice(*found[i - 1])]) if tied else "plain"
            after = _shape(text[slice(*found[i + 1])]) if follows else "plain"
            nodes.text.append(number)
            nodes.start.append(start)
            nodes.end.append(end)
            nodes.features.append(_features(word, before, after))
            nodes.labels.append(int(kinds[i]) if i >= 0 else LABELS - 1)
            nodes.bare.append(i < 0)
            if tied:
                nodes.next_to.append((node - 1, node))
            plain = _plain(word)
            digits = whole.get(i) or _digits(word)
            keys = [(0, plain)] if len(plain) > 3 else []
            if len(digits) >= 7:
                keys.append((1, digits[-7:]))
            if len(plain) > 3:
                local, at, _ = plain.partition("@")
                keys += [(2, part) for part in sorted({local if at else plain} | (named[i] if i >= 0 else set())) if len(part) > 3]
            for key in keys:
                if rows[key]:
                    (nodes.equal if key[0] == 0 else nodes.similar).append((rows[key][-1], node))
                rows[key].append(node)
        for key, row in rows.items() if mentions and own else ():
            if len(row) > 2:
                (nodes.equal_base if key[0] == 0 else nodes.similar_base).extend(_to_base(row, nodes.labels))
    return nodes


def _to_base(row: list[int], labels: list[int]) -> Iterator[tuple[int, int]]:
    """Links of a row's nodes to the last base span before them, or else the first one, without the row's own links."""
    bases = [i for i, node in enumerate(row) if labels[node] < LABELS - 1]
    base = bases[0] if bases else None
    for i, node in enumerate(row) if bases else ():
        if labels[node] < LABELS - 1:
            base = i
        elif abs(i - base) > 1:
            yield row[base], node


@dataclass(frozen=True)
class PiiModel:
    """Logits: of features by label, of neighbouring labels, and for sharing a label over an equal or a similar link."""

    weights: np.ndarray
    next_to: np.ndarray
    equal: float
    similar: float
    common: frozenset[str] = frozenset()  # plain words that are no names


def _links(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    pairs = [*nodes.next_to, *nodes.equal, *nodes.similar]
    kinds = np.repeat([0, 1, 2], [len(nodes.next_to), len(nodes.equal), len(nodes.similar)])
    return np.array(pairs, np.int64).reshape(-1, 2), kinds


_SHARE = np.diag(np.append(np.ones(LABELS - 1), 0.0))  # agreeing on plain is worth nothing


def _repetitions(text: str, own: list[Span], pick: random.Random) -> tuple[str, list[Span]]:
    """``text`` and its spans, with a repetition of one phone, card or address that the patterns miss."""
    told = [(start, kind, end) for start, kind, end in own if KINDS[kind] in ("email", "card", "phone")]
    if not told:
        return text, own
    start, kind, end = pick.choice(told)
    if KINDS[kind] == "email":
        again = text[start:end].partition("@")[0]
        if not _DIGIT.search(again):
            return text, own
    else:
        digits = _digits(text[start:end])
        tail = digits[-10:]
        again = pick.choice([f"{tail[:-7]}-{tail[-7:-4]}-{tail[-4:]}", f"({tail[:-7]}) {tail[-7:-4]}-{tail[-4:]}", tail, f"{tail[-7:-4]}-{tail[-4:]}"])
    longer = f"{text} {pick.choice(['then', 'or', 'call', 'see', 'x'])} {again} and"
    begin = len(longer) - len(again) - 4
    return longer, [*own, (begin, kind, begin + len(again))]


def _word_counts(texts: list[str]) -> Counter[str]:
    """How many texts have each plain word that could be a mention."""
    seen = Counter(word for text in texts for word in {_plain(w) for w in set(_WORD.findall(text))})
    return Counter({word: n for word, n in seen.items() if _nameable(word) and not _JOINED.search(word)})


def _asked(text: str) -> set[str]:
    """What mentions of the e-mail addresses of a text are sought by, and perhaps more."""
    if "@" not in text:
        return set()
    whole = {_plain(m.group()).partition("@")[0] for m in _NODE.finditer(text) if "@" in m.group()}
    return whole.union(_plain(text[start:end].partition("@")[0]) for start, end in _emails(text))


def _common_from(documents: int) -> float:
    return max(COMMON, COMMON_SHARE * documents)


def common_words(docs: DataFrame, text: str = "text") -> frozenset[str]:
    """The plain words of ``COMMON`` documents and ``COMMON_SHARE`` of all, counted over every document, that an address of any of them asks for.

    Tasks count by Arrow batch and the counts combine by word; only those common words come to the driver, at most 1 / ``COMMON_SHARE`` times the
    words of a mean document.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, asked = Counter(), set()
            for texts in _slices(batch.column(0)):
                seen.update(_word_counts(texts))
                asked.update(*map(_asked, texts))
            words = [*seen, *(w for w in asked if w not in seen and _nameable(w))]
            columns = [pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64()), pa.array([w in asked for w in words], pa.bool_())]
            yield pa.record_batch(columns, names=["word", "n", "asked"])

    counted = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL").mapInArrow(lean(count), "word string, n long, asked boolean")
    words = counted.groupBy("word").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    return frozenset(r["word"] for r in words.filter(F.col("asked") & (F.col("n") >= _common_from(docs.count()))).collect())


def train(texts: list[str], steps: int = 200, rate: float = 0.1, common: frozenset[str] | None = None) -> PiiModel | None:
    """Adagrad on the pseudo-likelihood of base labels, each node given its linked nodes' labels. ``common`` words are by default those of ``texts``."""
    pick = random.Random(_SEED)
    if common is None:
        common = frozenset(w for w, n in _word_counts(texts).items() if n >= _common_from(len(texts)))
    told = [_repetitions(t, base_spans(t), pick) for t in texts]
    nodes = nodes_of([t for t, _ in told], [own for _, own in told])
    if not nodes.text:
        return None
    rng = np.random.default_rng(_SEED)
    features, gold = np.array(nodes.features), np.array(nodes.labels)
    pairs, kinds = _links(nodes)
    n = len(gold)
    weights, next_to, shares = np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.full(2, SHARED)
    seen = [np.full_like(x, 1e-6) for x in (weights, next_to, shares)]
    a, b = pairs[:, 0], pairs[:, 1]
    beside, far = kinds == 0, kinds > 0
    hot = np.eye(LABELS)
    counted = np.zeros((n, 2, LABELS))  # labels other than plain among equal and among similar nodes
    for one, other in ((a, b), (b, a)):
        np.add.at(counted, (one[far], kinds[far] - 1), hot[gold[other[far]]] * np.append(np.ones(LABELS - 1), 0))
    for _ in range(steps):
        shown = rng.random(features.shape) < 0.5
        logits = np.einsum("nfl,nf->nl", weights[features], shown)
        np.add.at(logits, b[beside], next_to[gold[a[beside]]])
        np.add.at(logits, a[beside], next_to.T[gold[b[beside]]])
        logits += np.einsum("nkl,k->nl", counted, shares)
        error = np.exp(logits - logits.max(1, keepdims=True))
        error = error / error.sum(1, keepdims=True) - hot[gold]
        grads = [np.zeros_like(weights), np.zeros_like(next_to), np.einsum("nkl,nl->k", counted, error) / n + 1e-5 * shares]
        for column in range(features.shape[1]):
            used = np.flatnonzero(shown[:, column])
            np.add.at(grads[0], features[used, column], error[used] / n)
        grads[0] += 1e-4 * weights
        np.add.at(grads[1], gold[a[beside]], error[b[beside]] / n)
        np.add.at(grads[1].T, gold[b[beside]], error[a[beside]] / n)
        for value, grad, total, speed in zip((weights, next_to, shares), grads, seen, (rate, rate, SHARED_RATE)):
            total += grad**2
            value -= speed * grad / np.sqrt(total)
    return PiiModel(weights, next_to, *map(float, np.maximum(shares, 0)), common)


def _chains(links: list[tuple[int, int]]) -> list[list[int]]:
    """The rows of nodes that ``links``, each from a row's last node so far to its next, make up."""
    rows, ending = [], defaultdict(list)
    for one, other in links:
        if not ending[one]:
            rows.append([one])
            ending[one].append(rows[-1])
        row = ending[one].pop()
        row.append(other)
        ending[other].append(row)
    return rows


def _framed(chains: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains of up to ``BLOCK`` nodes by the power of two that holds their length, the longer ones each by itself: (nodes, valid)."""
    by_width: dict[int, list[list[int]]] = {}
    for chain in chains:
        by_width.setdefault(1 << (len(chain) - 1).bit_length(), []).append(chain)
    out = []
    for width, rows in by_width.items():
        for group in [rows] if width <= BLOCK else [[row] for row in rows]:
            wide = max(map(len, group))
            valid = np.arange(wide) < np.array([len(row) for row in group])[:, None]
            index = np.zeros(valid.shape, np.int64)
            index[valid] = np.concatenate(group)
            out.append((index, valid))
    return out


def _swept(logits: np.ndarray, valid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What chains tell their nodes, whose logits without it are ``logits``: one sweep forwards and one backwards, exact."""
    step = np.exp(table)
    own = np.maximum(logits - logits.max(-1, keepdims=True), -_LEAST)
    emission = np.exp(own)
    emission[:, 0] /= step.sum(0)  # a chain begins without a step
    if logits.shape[1] > BLOCK:
        probable = marginals(emission[valid], np.array([valid.sum()]), step)[None]
    else:
        even = np.full((len(logits), LABELS), 1 / LABELS)
        forward, backward = block_messages(emission, valid, step, even, even)
        probable = forward * backward
    told = np.log(probable) - own
    return told - told.max(-1, keepdims=True)


def probabilities(model: PiiModel, nodes: Nodes, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every node by loopy belief propagation; a round sweeps all rows of links, those with base spans first.

    It goes on until messages settle, ``rounds`` times at most; those of rounds after ``FREE`` are damped.
    """
    belief = model.weights[np.array(nodes.features)].sum(1)
    belief[np.array(nodes.bare)] = 0
    observed = np.array(nodes.labels)
    based = np.flatnonzero(observed < LABELS - 1)
    belief[based, observed[based]] += _OBSERVED
    equal, similar = model.equal * _SHARE, model.similar * _SHARE
    far = [(chain, table) for links, table in ((nodes.equal, equal), (nodes.similar, similar)) for chain in _chains(links)]
    # rows with a base span come first: words without one only confirm each other, in whatever they lean to
    anchored = [(observed[chain] < LABELS - 1).any() for chain, _ in far]
    rows = [(nodes.equal_base, equal), (nodes.similar_base, similar)]
    rows += [([c for (c, own), x in zip(far, anchored) if x and own is table], table) for table in (equal, similar)]
    rows.append((_chains(nodes.next_to), model.next_to))
    rows += [([c for (c, own), x in zip(far, anchored) if not x and own is table], table) for table in (equal, similar)]
    framed = [(*f, table) for chains, table in rows for f in _framed(chains)]
    # links stay within a document, so each goes on until its own messages settle, whatever it is read with
    document = np.array(nodes.text)
    messages = [np.zeros((*index.shape, LABELS)) for index, _, _ in framed]
    unsettled = np.ones(document.max() + 1, bool)
    for number in range(rounds):
        moved = np.zeros(len(unsettled))
        for k, (every, filled, table) in enumerate(framed):
            rows = np.flatnonzero(unsettled[document[every[:, 0]]])
            if not len(rows):
                continue
            index, valid = every[rows], filled[rows]
            at = index[valid]
            without = np.zeros((*index.shape, LABELS))
            told = messages[k][rows][valid]
            without[valid] = belief[at] - told
            change = _swept(without, valid, table)[valid] - told
            change[observed[at] < LABELS - 1] = 0
            if number >= FREE:
                change *= 0.5
            updated = messages[k][rows]
            updated[valid] += change
            messages[k][rows] = updated
            np.add.at(belief, at, change)
            np.maximum.at(moved, document[at], np.abs(change).max(1))
        unsettled &= moved > SETTLED
        if not unsettled.any():
            break
    shares = np.exp(belief - belief.max(1, keepdims=True))
    return shares / shares.sum(1, keepdims=True)


def _tied(nodes: Nodes, label: np.ndarray) -> np.ndarray:
    """Nodes that far links, over nodes of their own label, tie to a base span of it."""
    top = list(range(len(label)))

    def root(node: int) -> int:
        while top[node] != node:
            top[node] = node = top[top[node]]
        return node

    for a, b in [*nodes.equal, *nodes.similar, *nodes.equal_base, *nodes.similar_base]:
        if label[a] == label[b]:
            top[root(b)] = root(a)
    roots = np.array([root(node) for node in range(len(label))])
    return np.isin(roots, roots[np.array(nodes.labels) < LABELS - 1])


def all_spans(texts: list[str], model: PiiModel | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, base and added spans) of each text."""
    base = [base_spans(t) for t in texts]
    every = [list(own) for own in base]
    nodes = nodes_of(texts, base, mentions=True, common=model.common) if model is not None else None
    if nodes is None or not nodes.text:
        return base, every
    probable = probabilities(model, nodes)
    label = np.where(probable.max(1) >= CONFIDENCE, probable.argmax(1), LABELS - 1)
    tied = _tied(nodes, label)
    label[np.array(nodes.labels) < LABELS - 1] = LABELS - 1  # base spans stand as they are
    linked = set(nodes.next_to)
    run: list[int] = []
    for node in [*np.flatnonzero(label < LABELS - 1).tolist(), -1]:
        if run and not (node >= 0 and (run[-1], node) in linked and label[node] == label[run[-1]]):
            number = nodes.text[run[0]]
            start, end, text = nodes.start[run[0]], nodes.end[run[-1]], texts[number]
            while end > start and text[end - 1] in _TRIM:
                end -= 1
            while start < end and text[start] in _TRIM and not (text[start] == "(" and ")" in text[start:end]):
                start += 1
            if start < end and tied[run].any():
                every[number].append((start, int(label[run[0]]), end))
            run = []
        run.append(node)
    return base, [sorted(own) for own in every]


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first decides."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> PiiModel | None:
    """Train on a hash sample of about ``sample`` documents that have a digit or an ``@``; it and the common words of all documents come to the driver."""
    rank = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40))
    fitting = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), rank.alias("rank")).filter(F.col("text").rlike("[0-9@]"))
    share = min(1.0, sample / max(fitting.count(), 1))
    chosen = fitting.filter(F.col("rank") < share * (1 << 40)).select("doc_id", "text").orderBy("doc_id", "text")
    return train([r["text"] for r in chosen.collect()], common=common_words(docs, text))


def _slices(column: pa.Array, most: int = 4_000_000) -> Iterator[list[str]]:
    held, size = [], 0
    for value in column:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_personal_data(docs: DataFrame, model: PiiModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, how many base spans of each kind, their digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for texts in _slices(batch.column(1)):
                for base, every in zip(*all_spans(texts, shared.value)):
                    counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=_FOUND_NAMES)

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(lean(find), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


_FOUND_NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def mask_personal_data(docs: DataFrame, model: PiiModel | None, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text masked; NULL texts and all other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(place), []
            for texts in _slices(column):
                _, every = all_spans(texts, shared.value)
                out += [masked(t, spans) for t, spans in zip(texts, every)]
            changed = pa.array([o if v.is_valid else None for o, v in zip(out, column)], column.type)
            yield pa.record_batch([changed if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(lean(mask), docs.schema)
