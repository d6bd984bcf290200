"""PII: patterns with checks, and a linear-chain conditional random field over word shapes that finds what they miss.

The field tags the words of every line (B, I, O for each kind), with weights on features of a word's shape and of the
words beside it and on pairs of tags.  It is trained here, from the small labelled table of :func:`labelled_table`, by
gradient ascent on the log-likelihood (forward-backward), and decoded by Viterbi in numpy over many lines at once: the
words of a batch fall into few shape classes, so features are computed for each class and not for each word.  Its spans
are added where they overlap no span of the patterns.

Defined results: a null text is empty and has no spans; rows with equal doc_id give a row each; an empty table gives an
empty result; columns other than doc_id and text aren't read; texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"

# Patterns: each as leftmost non-overlapping matches, in forms that take linear time on any text.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """The local part before an @ is the whole run of its characters since the last match, as its leftmost start is."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            done = found.end()
            out.append((begin, done))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_card(word: str) -> bool:
    return 13 <= len(word) <= 19 and word.isascii() and word.isdigit() and luhn(word)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = emails(text)
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


#: Words that often stand before personal data or secrets.
CUES = ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "mail", "email", "e-mail", "phone", "tel", "telefon", "call", "ip", "host", "card", "visa", "karte", "tarjeta", "carte", "version", "license", "licence", "licensed")
#: Spelled-out signs, in brackets only: the bare words are common in clean text.
SPELLED = ("[at]", "(at)", "[dot]", "(dot)")
EDGE = "\"'`.,;:!?()[]{}<>"
ODD = r"(?i)[0-9@=+]|[\[(](at|dot)[\])]"


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs of one kind as one, other characters as they are."""
    out = []
    for c in word:
        s = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != s or s not in "0Aa":
            out.append(s)
    return "".join(out)


def features(word: str) -> tuple[str, ...]:
    core = word.strip(EDGE)
    low = core.lower()
    digits = sum(c.isdigit() for c in core)
    if word.lower().strip(".,") in SPELLED:
        return ("spelled=" + word.lower().strip(".,"),)
    if not re.search(ODD, word):
        return ("cue=" + low,) if low in CUES else ("plain",)
    found = ["shape=" + shape(core), "digits=" + str(min(digits, 20)), "long=" + str(min(len(core) // 4, 12))]
    found += [name for name, ok in (("at", "@" in core), ("equals", "=" in core), ("plus", core.startswith("+")), ("dots3", core.count(".") == 3), ("quoted", word[:1] in "\"'"), ("paren", word[:1] == "("), ("luhn", is_card(core)), ("no_luhn", 13 <= digits == len(core) <= 19 and not is_card(core)), ("hex", digits > 1 and len(core) >= 16 and not set(low) - set("0123456789abcdef")), ("upper_mix", digits > 0 and len(core) >= 16 and core.isalnum() and core.upper() == core and not core.isdigit()), ("all_digits", core.isdigit()), ("symbols", digits == 0)) if ok]
    if "=" in core and (head := low.split("=")[0]) in CUES:
        found.append("head=" + head)
    return tuple(found)


def with_check_digit(digits: str) -> str:
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def labelled_table(n: int = 480, seed: int = 5) -> list[list[tuple[str, str]]]:
    """A small labelled table: ``n`` lines of (word, tag), made by rule from templates and drawn syllables.

    Templates are forms that such data has in prose, settings and code, with decoys of like shapes: numbers that fail the
    check of cards, versions, dates, amounts, assignments of plain words, hashes of files.
    """
    rng = np.random.default_rng(seed)
    syllables = "the and er on st ing tion ha re ou der die sch en ge lich el la de que os ar cion le un pour eau ment et".split()
    pick = lambda x: x[int(rng.integers(len(x)))]
    upto = lambda a, b: int(rng.integers(a, b))
    stem = lambda a=1, b=4: "".join(pick(syllables) for _ in range(upto(a, b)))
    word = lambda: (lambda w: w.capitalize() if rng.random() < 0.1 else w)(stem()) + (pick([",", "."]) if rng.random() < 0.15 else "")
    number = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k - 3)) + "a7" + pick("0123456789")
    mixed = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k - 2)) + "Q7"
    cue = lambda: pick(["token", "secret", "key", "password", "passwd", "pwd", "apikey", "api_key"])
    host = lambda: f"{stem()}.{pick(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk'])}"
    kinds = ["email", "spelled", "ip", "card", "phone", "phone_local", "secret_quoted", "secret_bare", "secret_colon", "secret_key", "no_card", "no_small", "no_version", "no_number", "no_word", "no_assigned", "no_date"]

    def item() -> list[tuple[str, str]]:
        kind = pick(kinds)
        end = pick(["", "", "", ".", ","])
        if kind == "email":
            return [(f"{stem()}{pick(['', '.', '_', '+'])}{stem()}{number(upto(0, 4))}@{host()}{end}", "B-email")]
        if kind == "spelled":
            left, right = pick([("[", "]"), ("(", ")")])
            return [(stem(), "B-email"), (f"{left}at{right}", "I-email"), (f"{host()}{end}", "I-email")]
        if kind == "ip":
            return [(".".join(str(int(v)) for v in rng.integers(1, 255, 4)) + end, "B-ip")]
        if kind == "card":
            return [(with_check_digit(number(pick([14, 15, 15, 15, 17]))) + end, "B-card")]
        if kind == "phone":
            return [(f"+{1 + upto(0, 60)}", "B-phone"), (f"({number(3)})", "I-phone"), (f"{number(3)}-{number(4)}{end}", "I-phone")]
        if kind == "phone_local":
            return [(f"({number(3)})", "B-phone"), (f"{number(3)}-{number(4)}{end}", "I-phone")]
        if kind == "secret_quoted":
            quote = pick("\"'")
            return [(cue(), "O"), (pick(["=", ":="]), "O"), (f"{quote}{hexes(upto(20, 65))}{quote}{end}", "B-secret")]
        if kind == "secret_bare":
            return [(f"{cue()}={hexes(upto(12, 33))}{end}", "B-secret")]
        if kind == "secret_colon":
            return [(f"{cue()}:", "O"), (f"{hexes(upto(20, 65))}{end}", "B-secret")]
        if kind == "secret_key":
            return [(mixed(upto(16, 33)) + end, "B-secret")]
        if kind == "no_card":
            digits = number(16)
            return [(digits + end, "B-card" if luhn(digits) else "O")]
        if kind == "no_small":
            return [(pick(["2.0.", "4.0.", "3.", "1.2.3", "10%", "1999", "2024.", "7", "12", "365", "(3)", "3-4", "1,000", "50,000.", "x=1", "a=b", "=", "+", "C++", "@", "@@", "++"]), "O")]
        if kind == "no_version":
            return [("Version", "O"), (f"{number(1)}.{number(1)}{end}", "O")]
        if kind == "no_number":
            return [(number(upto(1, 9)) + end, "O")]
        if kind == "no_assigned":
            return [(f"{stem()}={pick([stem(), number(3), 'true', 'None'])}{end}", "O")]
        if kind == "no_date":
            return [(f"20{number(2)}-0{1 + upto(0, 8)}-1{number(1)}{end}", "O")]
        return [(pick(["at", "dot", f"{pick(syllables)}{number(upto(1, 4))}"]) + end, "O")]

    out = []
    for _ in range(n):
        line: list[tuple[str, str]] = []
        for _ in range(upto(0, 4)):
            line += [(word(), "O") for _ in range(upto(0, 5))] + item()
        out.append(line + [(word(), "O") for _ in range(upto(1, 5))])
    return out


class Field:
    """A linear-chain conditional random field.  ``weights[side]`` has a row of tag weights for each feature of the word (0), the one before (1), the one after (2)."""

    def __init__(self, lines: list[list[tuple[str, str]]], steps: int = 150, rate: float = 0.25, decay: float = 1e-3):
        names = sorted({f for line in lines for w, _ in line for f in features(w)} | {"edge"})
        self.index = {f: k for k, f in enumerate(names)}
        k, (rows, width) = len(TAGS), (len(lines), max(map(len, lines)))
        self.allowed = np.array([[not (b.startswith("I-") and a[2:] != b[2:]) for b in TAGS] for a in TAGS])
        self.first = np.array([0.0 if not t.startswith("I-") else -1e4 for t in TAGS])
        # three one-hot blocks for every place of every line, summed: sparse as index lists
        place, feature, gold = [], [], np.zeros((rows, width), dtype=int)
        there = np.zeros((rows, width), dtype=bool)
        for r, line in enumerate(lines):
            own = [[self.index[f] for f in features(w)] for w, _ in line]
            for t, (_, tag) in enumerate(line):
                gold[r, t], there[r, t] = TAGS.index(tag), True
                for side, at in ((0, t), (1, t - 1), (2, t + 1)):
                    for f in own[at] if 0 <= at < len(line) else [self.index["edge"]]:
                        place.append(r * width + t)
                        feature.append(side * len(names) + f)
        place, feature = np.array(place), np.array(feature)
        w, pairs = np.zeros((3 * len(names), k)), np.where(self.allowed, 0.0, -1e4)
        sums = [np.zeros_like(w), np.zeros_like(pairs)]
        target = np.zeros((rows * width, k))
        target[np.arange(rows * width), gold.ravel()] = there.ravel()
        pair_target = np.zeros((k, k))
        both = there[:, 1:]
        np.add.at(pair_target, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for _ in range(steps):
            score = np.zeros((rows * width, k))
            np.add.at(score, place, w[feature])
            score = score.reshape(rows, width, k)
            ahead, back = np.zeros_like(score), np.zeros_like(score)
            ahead[:, 0] = score[:, 0] + self.first
            for t in range(1, width):
                ahead[:, t] = np.where(there[:, t, None], score[:, t] + lse(ahead[:, t - 1, :, None] + pairs, 1), ahead[:, t - 1])
            total = lse(ahead[:, -1], 1)
            for t in range(width - 2, -1, -1):
                back[:, t] = np.where(there[:, t + 1, None], lse(pairs + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
            marginal = np.exp(ahead + back - total[:, None, None]) * there[:, :, None]
            pair = np.exp(ahead[:, :-1, :, None] + pairs + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
            gradient = np.zeros_like(w)
            np.add.at(gradient, feature, (target - marginal.reshape(-1, k))[place])
            for value, grad, s in ((w, gradient - decay * rows * w, sums[0]), (pairs, (pair_target - (pair * both[:, :, None, None]).sum((0, 1))) * self.allowed, sums[1])):
                s += grad * grad
                value += rate * grad / np.sqrt(s + 1e-8)
        self.weights, self.pairs = w.reshape(3, len(names), k), np.where(self.allowed, pairs, -1e4)

    def emission(self, names: tuple[str, ...]) -> np.ndarray:
        """(3, tags): what a word of these features adds to its own, the next and the previous place."""
        known = [self.index[f] for f in names if f in self.index]
        return self.weights[:, known].sum(axis=1)

    def decode(self, classes: np.ndarray, ends: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Best tags for all lines at once.  classes: of every word; ends: line offsets; tables: (classes, 3, tags)."""
        k, n = len(TAGS), len(classes)
        edge = self.weights[:, self.index["edge"]]
        lengths = np.diff(ends)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        starts, lengths = ends[:-1][order], lengths[order]
        tags = np.zeros(n, dtype=np.int8)
        if not len(order):
            return tags
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lines longer than t
        come = np.zeros((int(lengths.sum()), k), dtype=np.int8)
        at = np.concatenate(([0], np.cumsum(active)))
        best, score = np.zeros((len(order), k), dtype=np.float32), None
        own, prev, nxt = (np.ascontiguousarray(tables[:, s], dtype=np.float32) for s in range(3))
        pairs, edge = self.pairs.astype(np.float32), edge.astype(np.float32)
        for t in range(steps):
            m = active[t]
            here = starts[:m] + t
            score = own[classes[here]] + (prev[classes[here - 1]] if t else edge[1])
            last = lengths[:m] == t + 1
            score += np.where(last[:, None], edge[2], nxt[classes[np.where(last, here, here + 1)]])
            if t:
                through = best[:m, :, None] + pairs
                come[at[t] : at[t] + m] = through.argmax(axis=1)
                best[:m] = score + through.max(axis=1)
            else:
                best[:m] = score + self.first.astype(np.float32)
        tag = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            m = active[t]
            tags[starts[:m] + t] = tag[:m]
            if t:
                tag[:m] = come[at[t] : at[t] + m][np.arange(m), tag[:m]]
        return tags


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field(labelled_table())


class Tagger:
    def __init__(self, field: Field):
        self.field, self.classes, self.tables = field, {}, []

    def class_of(self, word: str) -> int:
        names = tuple(f for f in features(word) if f in self.field.index)
        k = self.classes.setdefault(names, len(self.classes))
        if k == len(self.tables):
            self.tables.append(self.field.emission(names))
        return k

    def spans(self, texts: pa.Array) -> dict[int, list[tuple[str, int, int]]]:
        """Spans of the field, by row, in code points."""
        lines = pc.split_pattern(texts, "\n")
        line_ends = np.asarray(lines.offsets, dtype=np.int64)
        words = pc.ascii_split_whitespace(lines.flatten())
        flat, ends = words.flatten(), np.asarray(words.offsets, dtype=np.int64)
        filled = np.asarray(pc.binary_length(flat)) > 0
        before = np.concatenate(([0], np.cumsum(filled)))
        coded, ends = flat.filter(pa.array(filled)), before[ends]
        if not len(coded):
            return {}
        coded = coded.dictionary_encode()
        known = coded.dictionary
        plain = self.class_of("word")
        kind = np.full(len(known), plain, dtype=np.int32)
        core = pc.utf8_lower(pc.utf8_trim(known, EDGE))
        odd = np.asarray(pc.or_(pc.match_substring_regex(known, ODD), pc.is_in(core, pa.array(CUES, core.type))))
        for k, w in zip(np.flatnonzero(odd).tolist(), known.filter(pa.array(odd)).to_pylist(), strict=True):
            kind[k] = self.class_of(w)
        tags = self.field.decode(kind[np.asarray(coded.indices)], ends, np.array(self.tables))
        found = np.flatnonzero(tags)
        out: dict[int, list[tuple[str, int, int]]] = {}
        if len(found):
            word_row = np.searchsorted(ends[line_ends - line_ends[0]], found, side="right") - 1
            first = ends[line_ends - line_ends[0]]
            for row in np.unique(word_row).tolist():
                text = texts[row].as_py()
                own = tags[first[row] : first[row + 1]]
                out[row] = spans_of(text, own)
        return out


def spans_of(text: str, tags: np.ndarray) -> list[tuple[str, int, int]]:
    out: list[list] = []
    hits = set(np.flatnonzero(tags).tolist())
    last = max(hits, default=-1)
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if k > last:
            break
        if k in hits:
            position, kind = TAGS[tags[k]].split("-")
            if position == "I" and out and out[-1][0] == kind and out[-1][3] == k - 1:
                out[-1][2], out[-1][3] = m.end(), k
            else:
                out.append([kind, m.start(), m.end(), k])
    trimmed = []
    for kind, a, b, _ in out:
        edge = EDGE.replace("(", "").replace(")", "").replace("[", "").replace("]", "") if kind in ("phone", "email") else EDGE
        while a < b and text[b - 1] in edge:
            b -= 1
        while a < b and text[a] in edge:
            a += 1
        if a < b:
            trimmed.append((kind, a, b))
    return trimmed


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def found_in(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    tagger = Tagger(shared.value)
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = strings(batch.column(1))
        for a, b in slices(texts):
            part = texts[a:b]
            more = tagger.spans(part)
            maybe = set(np.flatnonzero(np.asarray(pc.match_substring_regex(part, "[0-9@]"))).tolist())
            rows = []
            for k, doc in enumerate(batch.column(0)[a:b].to_pylist()):
                if k not in maybe and k not in more:
                    rows.append((doc, 0, 0, 0, 0, nothing, "", 0, 0))
                    continue
                base = base_spans(part[k].as_py())
                every = [(kind, *s) for kind in BASE for s in base[kind]]
                text = joined(every)
                added = [s for s in more.get(k, []) if not any(s[1] < y and x < s[2] for _, x, y in every)]
                rows.append((doc, *(len(base[kind]) for kind in BASE), hashlib.sha256(text.encode()).hexdigest(), joined(every + added), sum(x[0] == "secret" for x in added), len(every) + len(added)))
            columns = list(zip(*rows, strict=True))
            types = (pa.int64(),) * 5 + (pa.string(),) * 2 + (pa.int64(),) * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_secret", "n_spans"])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, the numbers of pattern spans by kind, their digest, all spans as kind:start:end, and the numbers of secrets and of all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: found_in(it, shared), RESULT)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
