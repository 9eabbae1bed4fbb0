"""Personal data and secrets by a semi-Markov conditional random field.

A segmentation splits a text's tokens into entity segments and single outside tokens. Whole-span features (shape,
checksum, octets, hex length, what stands before and after) score each candidate segment for each type, and
dynamic programming over segment ends picks boundaries and types jointly. The weights maximise the likelihood of
labelled windows that training_windows() makes. Types: EMAIL, PHONE, IP (4 and 6), CARD, SECRET (keys, tokens, passwords),
SSN, IBAN.

A candidate segment has an anchor: a digit, "@", a lower-case letter before a capital, AKIA or ASIA, or a place right
after a key word ("password") and ":" or "=". It is
* one token,
* up to MAX_TOKENS tokens without white space, joined by . @ + % - (or : between hexadecimal groups); JOINED without @ and :,
* up to MAX_TOKENS tokens that all have digits, with single spaces, parentheses, dots, + and - among them,
* a whole mail address or a whole value after a key word, however many tokens it has, so that none is cut.
All of a text is searched for anchors. No candidate reaches beyond the white-space separated words that have
one, so decoding runs of such words gives what decoding the whole text gives (tests compare the two).

Nulls and odd input: a null text stays null and an empty one empty, with no entities. A null doc_id is handled
like any other, and ids may be of any type. Repeated rows give repeated results. A word without end is decoded whole in time
in proportion to its length; its tokens' scores are held in blocks. Lower-case words of fewer than 16 letters after a key
word ("password: required") are no secrets. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import ipaddress
import random
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import textvec

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
MAX_TOKENS, JOINED = 17, 11
TRAINING_WINDOWS = 1600

_TOKEN = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff]+|[^\sA-Za-z0-9_\u0080-\U0010ffff]")
#: Anchors, and the marks after which a key word's value may stand.
_NEAR = re.compile(r"[0-9@:=]|[a-z][A-Z]|A[KS]IA")
_ANCHOR = re.compile(r"[0-9@]|[a-z][A-Z]|A[KS]IA")
_DIGIT = re.compile(r"[0-9]")
_KEYED = re.compile(r"(?i)(?:token|password|passwd|passphrase|secret|key|pwd|auth|bearer)[\"']?[ \t]?[:=][ \t]?[\"']?\Z")
_VALUE = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff+/.~=-]*[A-Za-z0-9_\u0080-\U0010ffff]")
_MAILRUN = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff.+%-]+@[A-Za-z0-9\u0080-\U0010ffff-]+(?:\.[A-Za-z0-9\u0080-\U0010ffff-]+)+")
_GROUP = re.compile(r"[0-9A-Fa-f]{1,4}\Z")
_END = re.compile(r"\s")
_SPACE = frozenset(" \t\n\r\x0b\x0c   ")
_FEATURES = 1 << 13


def _luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_OCTETS = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}\Z")
_MAIL = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+\Z")
_SHAPE = re.compile(r"(\d+)|([^\W\d_]+)|(\s+)|(.)", re.S)
_FLIP = re.compile("[a-z][A-Z]")
_MORE = re.compile(r"\s?\(?\d|-\d")
_GLUE = frozenset("@.-_+%/:")


@functools.lru_cache(1 << 16)
def _code(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 13) % _FEATURES


_HINT = frozenset(("token", "password", "passwd", "passphrase", "secret", "key", "apikey", "api_key", "pwd", "auth", "bearer", "phone", "tel", "call", "card", "visa", "ip", "ssn", "iban", "version", "mail", "email", "commit", "sha", "sha1", "md5", "rev", "revision", "hash", "checksum"))
#: Characters before a segment in which hints are looked for.
_BACK = 48


def hints(text: str, start: int) -> str:
    """The key words, and "=", among the four tokens in the _BACK characters before a place."""
    low = max(0, start - _BACK)
    found = [m for m in _TOKEN.finditer(text, low, start)]
    if low and found and found[0].start() == low and text[low - 1].isalnum():
        found = found[1:]  # a part of a token
    return " ".join(w for w in (m[0].lower() for m in found[-4:]) if w in _HINT or w == "=")


def span_features(text: str, start: int, end: int, before: str) -> list[int]:
    """Features of text[start:end] as one segment; before: its hints()."""
    return _features(text[start:end], text[max(0, start - 4) : start], text[end : end + 4], before)


@functools.lru_cache(1 << 13)
def _features(s: str, ahead: str, behind: str, before: str) -> list[int]:
    """Features of a segment by its text, the four characters on either side, and its hints()."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    nd, na = len(digits), sum(c.isalpha() for c in s)
    parts, short = [], []
    for m in _SHAPE.finditer(s):
        k = m.lastindex
        parts.append(f"9{min(len(m[0]), 6)}" if k == 1 else "a" if k == 2 else " " if k == 3 else m[0])
        short.append("9" if k == 1 else "a" if k == 2 else " " if k == 3 else m[0])
        if len(parts) > 14:
            break
    shape = "".join(parts) if len(parts) <= 12 else "long"
    out = ["bias", f"nd{min(nd, 20)}", f"na{min(na, 8)}", f"len{min(len(s).bit_length(), 8)}", "S" + shape, "s" + "".join(short[:14])]
    compact = len(s) == nd + na
    if nd and na and compact:
        out.append(f"mix{min(len(s) // 4, 10)}")
    if not nd and len(s) >= 8 and s[0].isalnum():
        flips, keyed = min(len(_FLIP.findall(s)), 4), before != "" and ahead.rstrip(" \"'")[-1:] in (":", "=")
        out += [f"flip{flips}", f"flip{flips}keyed{keyed}", f"size{min(len(s) // 8, 4)}keyed{keyed}flip{flips > 0}"]
    if not compact and len(s) >= 16 and "/" in s:
        out.append("path")
    if _HEX.match(s) and len(s) >= 12:
        out += ["hex", f"hex{min(len(s) // 4, 12)}"]
    if s[:4].upper() in ("AKIA", "ASIA") and len(s) == 20 and compact:
        out += ["keyid", f"keyid{nd > 0}"]
    if _OCTETS.match(s):
        out.append("octets" if all(int(x) < 256 for x in s.split(".")) else "overoctets")
    if s.count(":") >= 2:
        try:
            ipaddress.IPv6Address(s)
            out.append("v6")
        except ValueError:
            out.append("notv6")
    if "@" in s and _MAIL.match(s):
        out.append("mail")
    if 13 <= nd <= 19 and na == 0:
        out.append(f"luhn{_luhn(digits)}{digits[0] in '3456'}")
    if 7 <= nd <= 15 and na == 0 and len(s) > nd:
        out += ["tel", "tel+" if s[0] == "+" else "tel-"]
    left, right = ahead[-1:], behind[:1]
    if left and left not in _SPACE:
        out.append("L" + ("a" if left.isalnum() else left))
        if left in _GLUE and ahead[-2:-1].isalnum():
            out.append("Lglue")
    if right and right not in _SPACE:
        out.append("R" + ("a" if right.isalnum() else "."))
        if right in _GLUE and behind[1:2].isalnum():
            out.append("Rglue")
    if s[0] in "+(":
        out.append("^" + s[0])
    if left == "(" or left == "+":
        out.append("cut")
    if _MORE.match(behind):
        out.append("more")
    out.append("B" + before)
    for w in before.split():
        out.append("b" + w)
    return [_code(x) for x in dict.fromkeys(out)]


def keyed(text: str, start: int) -> bool:
    """Whether a key word's value begins here."""
    return text[start - 1 : start] in (":", "=", " ", "\t", '"', "'") and _KEYED.search(text, max(0, start - 32), start) is not None


def tokens_of(text: str, a: int, b: int) -> tuple[array, array]:
    starts, ends = array("q"), array("q")
    for m in _TOKEN.finditer(text, a, b):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def spans_from(text: str, starts: array, ends: array, i: int, b: int) -> tuple[bool, list[int]]:
    """Whether token i alone may be an entity, and where the longer candidates from it end (past the last token)."""
    n, at = len(starts), starts[i]
    first = text[at]
    word = first.isalnum() or first == "_"
    value = word and keyed(text, at)
    alone = word and (_ANCHOR.search(text, at, ends[i]) is not None or (value and ends[i] - at >= 8))
    out: list[int] = []
    if not word and first not in "+(" and text[at : at + 2] != "::":
        return alone, out
    anchor = alone or first == ":"
    space = paren = mail = colon = False
    digits, groups, filled = True, True, word
    j = i
    while j < n:
        x, y = starts[j], ends[j]
        if j > i and x > ends[j - 1]:
            if x - ends[j - 1] > 1 or text[x - 1] not in " \t" or not filled:
                break
            space, filled = True, False
        c = text[x]
        if c.isalnum() or c == "_":
            filled = True
            digits = digits and _DIGIT.search(text, x, y) is not None
            groups = groups and y - x <= 4 and _GROUP.match(text, x, y) is not None
            anchor = anchor or (j > i and _ANCHOR.search(text, x, y) is not None)
        elif c in "()":
            paren = True
        elif c in "@%":
            mail = True
            anchor = anchor or c == "@"
        elif c == ":":
            colon = True
        elif c not in ".+-":
            break
        if ((space or paren) and (not digits or mail or colon)) or (colon and (mail or not groups)):
            break
        if j - i + 1 > (MAX_TOKENS if space or mail or colon or paren else JOINED):
            break
        if j > i and filled and anchor and (c.isalnum() or c == "_"):
            out.append(j + 1)
        j += 1
    if word and (value or at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_.+%-@")):
        # whole mail addresses and whole values, of any length; only where such a run begins
        for run in (_MAILRUN,) + ((_VALUE,) if value else ()):
            if m := run.match(text, at, b):
                k = i
                while k < n and ends[k] < m.end():
                    k += 1
                if k < n and k > i and ends[k] == m.end() and k + 1 not in out:
                    out.append(k + 1)
    return alone, out


def block(text: str, starts: array, ends: array, first: int, last: int, b: int, reach: int) -> tuple[list[tuple[int, int]], list[list[int]], list[bool], int]:
    """Segments from tokens first to last, their features, whether they may be entities, and how far candidates reach.

    A token in no longer candidate that may not be an entity has no features: all segmentations share it.
    """
    segments, feats, may = [], [], []
    for i in range(first, last):
        alone, more = spans_from(text, starts, ends, i, b)
        before = hints(text, starts[i]) if alone or more or reach > i else ""
        reach = max([reach, *more])
        segments.append((i, i + 1))
        feats.append(span_features(text, starts[i], ends[i], before) if alone or reach > i else [])
        may.append(alone)
        for j in more:
            segments.append((i, j))
            feats.append(span_features(text, starts[i], ends[j - 1], before))
            may.append(True)
    return segments, feats, may, reach


def candidates(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[list[int]], list[bool]]:
    """A whole text's token spans; segments as (first token, past the last); their features; whether each may be an entity."""
    starts, ends = tokens_of(text, 0, len(text))
    segments, feats, may, _ = block(text, starts, ends, 0, len(starts), len(text), 0)
    return list(zip(starts, ends, strict=True)), segments, feats, may


def _padded(feats: list[list[int]]) -> np.ndarray:
    width = max(1, *map(len, feats)) if feats else 1
    return np.array([f + [_FEATURES] * (width - len(f)) for f in feats], np.int64).reshape(len(feats), width)


def potentials(weights: np.ndarray, segments: list[tuple[int, int]], index: np.ndarray, may: list[bool]) -> np.ndarray:
    """(segments, 1 + types) scores; column 0 is outside, for single tokens only; types only for what may be an entity."""
    s = weights[index].sum(1)
    s[[b - a > 1 for a, b in segments], 0] = -1e9
    s[~np.array(may, bool), 1:] = -1e9
    return s


def decode(weights: np.ndarray, text: str, a: int, b: int, step: int = 512) -> list[tuple[int, int, str]]:
    """The segmentation of text[a:b] of highest score, as its entities (start, end, type). Scores are made for so many tokens at a time."""
    starts, ends = tokens_of(text, a, b)
    n, reach = len(starts), 0
    value, back, kinds = array("d", [0.0] + [-1e18] * n), array("q", [-1]) * (n + 1), bytearray(n + 1)
    for at in range(0, n, step):
        segments, feats, may, reach = block(text, starts, ends, at, min(n, at + step), b, reach)
        scores = potentials(weights, segments, _padded(feats), may)
        for (i, j), k, top in zip(segments, scores.argmax(1).tolist(), scores.max(1).tolist(), strict=True):
            v = value[i] + top
            if v > value[j]:
                value[j], back[j], kinds[j] = v, i, k
    out, at = [], n
    while at > 0:
        if kinds[at]:
            out.append((starts[back[at]], ends[at - 1], TYPES[kinds[at] - 1]))
        at = back[at]
    return out[::-1]


def _gradient(n: int, segments: list[tuple[int, int]], scores: np.ndarray, gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the gold segmentation, and its gradient by segment and type."""
    top = scores.max(1)
    total = top + np.log(np.exp(scores - top[:, None]).sum(1))
    alpha, beta = np.full(n + 1, -1e18), np.full(n + 1, -1e18)
    alpha[0] = beta[n] = 0
    order = sorted(range(len(segments)), key=lambda k: segments[k])
    for k in order:
        a, b = segments[k]
        alpha[b] = np.logaddexp(alpha[b], alpha[a] + total[k])
    for k in reversed(order):
        a, b = segments[k]
        beta[a] = np.logaddexp(beta[a], beta[b] + total[k])
    a, b = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
    grad = np.exp(alpha[a][:, None] + scores + beta[b][:, None] - alpha[n])
    at = {s: k for k, s in enumerate(segments)}
    loss, covered = alpha[n], np.zeros(n, bool)
    for i, j, t in gold:
        grad[at[i, j], t] -= 1
        loss -= scores[at[i, j], t]
        covered[i:j] = True
    for i in np.flatnonzero(~covered):
        grad[at[i, i + 1], 0] -= 1
        loss -= scores[at[i, i + 1], 0]
    return loss, grad


def training_windows(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up windows with the character spans and types of their entities, and look-alikes that are none."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=2, b=10: "".join(r.choice(letters + "éüñ" * (r.random() < 0.1)) for _ in range(r.randint(a, b)))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice(letters + letters.upper() + "0123456789") for _ in range(k))

    cased = lambda k: r.choice("abcdefghij") + r.choice("ABCDEFGHIJ") + "".join(r.choice(letters + letters.upper()) for _ in range(k - 2))
    camel = lambda k: "".join(word(3, 6).capitalize() for _ in range(k))

    def unnumbered() -> tuple[str, str, str]:
        """Secrets of letters only."""
        key = r.choice(["token", "password", "secret", "api_key", "key", "passwd", "pwd", "auth"])
        key = r.choice([key, key, key.capitalize(), key.upper()])
        v = r.choice([cased(12), cased(12), cased(r.randint(9, 32)), camel(3), camel(4), "".join(r.choice(letters) for _ in range(r.randint(16, 32))), "-".join(word(4, 8) for _ in range(r.randint(4, 9)))])
        return r.choice([(f"{key}: ", v, ""), (f"{key}: ", v, ""), (f"{key}=", v, ""), (f'{key} = "', v, '"'), ("", r.choice(["AKIA", "ASIA"]) + "".join(r.choice(letters.upper()) for _ in range(16)), "")])

    def lettered() -> str:
        """Words in capitals, mixed case or after a key word that are no secrets."""
        key = r.choice(["token", "password", "secret", "key", "auth", "Password", "KEY", "note", "Note", "See"])
        return r.choice([f"{key}: {word()}", f"{key}: {word(8, 14)} {word()}", f"{key}: {word(4, 12).capitalize()}", f"{word()}{word(3, 8).capitalize()}", camel(2), camel(3), camel(4), f"{word(3, 6)}{camel(2)}", word(4, 20).upper(), f"{word()}: {word()}", f"{word()}: {camel(2)}", f"the {key} to {word(6, 12)}", "asia", "Asia", f"ASIA {word().upper()}", f"{key}: {word(8, 15)}", f"{key}: {word(3, 6)}-{word(3, 6)}", f"{word()}-{word()}-{word()}"])

    def mail() -> str:
        local = r.choice([f"{word()}", f"{word()}.{word()}", f"{word()}.{digits(2)}", f"{word()}{digits(2)}", f"{word(1, 1)}_{word()}", f"{word()}+{word()}", ".".join(word(1, 4) for _ in range(r.randint(3, 12)))])
        return f"{local}@{r.choice([word(), word() + digits(1), word() + '-' + word(2, 4)])}.{r.choice(['com', 'org', 'example.com', 'co.uk', 'example.net', 'de', 'io'])}"

    def phone() -> str:
        return r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{r.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}", f"+{r.randint(20, 99)} {digits(3)} {digits(7)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(11)}"])

    def checked(d: str, ok: bool = True) -> str:
        """The digits with a last one that makes the checksum right, or wrong."""
        right = next(x for x in "0123456789" if _luhn(d + x))
        return d + (right if ok else r.choice([x for x in "0123456789" if x != right]))

    def grouped(d: str) -> str:
        return r.choice([d, d, d, "-".join(d[i : i + 4] for i in range(0, len(d), 4)), " ".join(d[i : i + 4] for i in range(0, len(d), 4))])

    def card() -> str:
        return grouped(checked(r.choice("3456") + digits(14)) if r.random() < 0.9 else checked(r.choice(["34", "37"]) + digits(12)))

    def uncard() -> str:
        """Numbers as long as a card's that are none: a wrong checksum, or a first digit that no card has."""
        return grouped(checked(r.choice("3456") + digits(14), False) if r.random() < 0.6 else checked(r.choice("012789") + digits(14), r.random() < 0.5))

    def address() -> str:
        g = lambda: f"{r.randint(0, 65535):x}"
        four = ".".join(str(r.randint(0, 255)) for _ in range(4))
        return r.choice([four, four, four, ":".join(g() for _ in range(8)), f"{g()}:{g()}::{g()}", f"{g()}::{g()}:{g()}:{g()}"])

    def secret() -> tuple[str, str, str]:
        key = r.choice(["token", "password", "secret", "api_key", "key", "passwd", "pwd", "auth"])
        v = r.choice([hexes(40), hexes(32), hexes(18), hexes(64), mixed(24), mixed(32), mixed(12), f"{mixed(13)}/{mixed(9)}+{mixed(16)}", f"{mixed(20)}.{mixed(30)}.{mixed(24)}"])
        return r.choice([(f'{key} = "', v, '"'), (f"{key}=", v, ""), (f"{key}='", v, "'"), (f"{key}: ", v, ""), ("", r.choice(["AKIA", "AKIA", "ASIA"]) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567890") for _ in range(16)), ""), ("", hexes(40), "")])

    def plain() -> str:
        return r.choice([f"version {r.randint(1, 9)}.{r.randint(0, 20)}.", f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(1900, 2040)}", f"{r.randint(1900, 2040)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1900, 2040)}", f"{r.randint(0, 23)}:{r.randint(0, 59):02}", f"${r.randint(1, 999)}.{digits(2)}", f"{r.randint(1, 999)},{digits(3)},{digits(3)}", f"{r.randint(1, 99)}%", f"{digits(r.randint(1, 6))}", f"CC BY-NC {r.randint(1, 4)}.0.", f"x = {digits(2)}", f"{word(1, 3)} = {word()}", f"{r.randint(0, 9)}.{digits(4)}", f"page {digits(2)} of {digits(3)}", f"{word()}{digits(1)}", f"@{word()}", f"[{digits(2)}]", f"{digits(1)}.{digits(1)}.{digits(1)}", f"a{digits(1)}-b{digits(2)}", f"({r.randint(1900, 2040)})", f"== {word()} ==", f"{digits(2)} {digits(2)} {digits(3)}", f"x=y", f"{word()}@", f"{word()}-{digits(4)}", f"no. {digits(4)}", f"300.400.500.{digits(3)}", uncard(), uncard(), uncard(), uncard(), uncard(), uncard(), f"{r.randint(0, 23)}:{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}", f"{word()}/{word()}{digits(2)}/{word()}.{word(2, 4)}", f"{digits(2)}/{digits(2)}"])

    rows = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 3))), []
        for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
            text += (r.choice([" ", " ", "\n", " | "]) if text else "")
            kind = r.choice(["EMAIL", "PHONE", "IP", "CARD", "SECRET", "UNNUMBERED", "SSN", "IBAN", None, None, None, "LETTERED", "HASH"])
            pre = post = ""
            shout = r.random() < 0.15 and kind not in ("UNNUMBERED", "LETTERED")
            if kind == "UNNUMBERED":
                (pre, v, post), kind = unnumbered(), "SECRET"
            elif kind == "LETTERED":
                v, kind = lettered(), None
            elif kind == "HASH":
                v, kind = f"{r.choice(['commit', 'Commit', 'commit:', 'sha1', 'sha1:', 'md5', 'rev', 'hash', 'hash:', 'checksum:', 'revision'])} {hexes(r.choice([7, 12, 32, 40, 40, 40]))}", None
            elif kind == "SECRET":
                pre, v, post = secret()
            else:
                v = mail() if kind == "EMAIL" else phone() if kind == "PHONE" else address() if kind == "IP" else card() if kind == "CARD" else f"{digits(3)}-{digits(2)}-{digits(4)}" if kind == "SSN" else r.choice(["DE", "FR", "ES", "GB"]) + digits(2) + (digits(18) if r.random() < 0.6 else "".join(" " + digits(4) for _ in range(4)) + " " + digits(2)) if kind == "IBAN" else plain()
            if kind not in ("SECRET",) and not pre and r.random() < 0.12:  # in quotes, as a value of JSON or of a tag
                pre, post = r.choice([('"', '"'), ("'", "'"), (f'{{"{word()}":"', '",'), (f'"{word()}": "', '"}'), (">", "<"), (f"{word()}:", ""), (f"{r.choice(['ip', 'email', 'phone', 'card', 'ssn', 'iban'])}: ", "")])
            if shout:
                pre, v = pre.upper(), v.upper()
            text += pre
            if kind:
                spans.append((len(text), len(text) + len(v), kind))
            text += v + post + r.choice(["", "", "", "", ".", ",", ")", ";", "?", *("".join(r.choice("!?#$%&*~|<>]}") for _ in range(r.randint(1, 4))) for _ in range(4))])
            if r.random() < 0.5:
                text += " " + " ".join(word() + r.choice(["", "", ".", "".join(r.choice("!?#$%&*~") for _ in range(r.randint(1, 3)))]) for _ in range(r.randint(1, 2)))
        rows.append((text, spans))
    return rows


def _gold(tokens: list[tuple[int, int]], segments: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int, int]] | None:
    starts, ends, have, out = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}, set(segments), []
    for a, b, t in spans:
        if a not in starts or b not in ends or (starts[a], ends[b]) not in have:
            return None
        out.append((starts[a], ends[b], TYPES.index(t) + 1))
    return out


@functools.lru_cache(4)
def train(windows: int = TRAINING_WINDOWS, epochs: int = 10, rate: float = 0.3, l2: float = 1e-4, seed: int = 11) -> np.ndarray:
    """(features + 1, 1 + types) weights; the last row, of no feature, is 0. AdaGrad on the likelihood."""
    data = []
    for text, spans in training_windows(windows, seed):
        tokens, segments, feats, may = candidates(text)
        if tokens and (gold := _gold(tokens, segments, spans)) is not None:
            data.append((len(tokens), segments, _padded(feats), may, gold))
    w = np.zeros((_FEATURES + 1, 1 + len(TYPES)))
    w[_code("bias"), 0] = 1.0
    seen, order = np.full_like(w, 1e-6), random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for at in range(0, len(data), 16):
            g = l2 * w
            for n, segments, index, may, gold in data[at : at + 16]:
                _, d = _gradient(n, segments, potentials(w, segments, index, may), gold)
                np.add.at(g, index, np.repeat(d[:, None, :], index.shape[1], 1) / 16)
            g[_FEATURES] = 0
            seen += g * g
            w -= rate * g / np.sqrt(seen)
    return w


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Runs of consecutive words of one line that each have an anchor, or a value after a key word."""
    n, at = len(text), 0

    def anchor(pos: int) -> int:
        """The first place from pos on that makes a word anchored, or -1."""
        while m := _NEAR.search(text, pos):
            p = m.start()
            if text[p] not in ":=":
                return p
            v = p + 1
            if text[v : v + 1] in (" ", "\t"):
                v += 1
            if text[v : v + 1] in ('"', "'"):
                v += 1
            if text[v : v + 1].isalnum() and keyed(text, v):
                return v
            pos = p + 1
        return -1

    p = anchor(0)
    while p >= 0:
        a = p
        while a > at and not text[a - 1].isspace():
            a -= 1
        end = m.start() if (m := _END.search(text, p)) else n
        while True:
            p = anchor(end) if end < n else -1
            start = end
            while start < n and text[start].isspace():
                start += 1
            stop = m.start() if (m := _END.search(text, start)) else n
            if p < 0 or p >= stop or "\n" in text[end:start]:
                break
            end = stop
        yield a, end
        at = end


class Tagger:
    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}

    def entities(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        for a, b in windows(text):
            # features look at most so far around a segment
            key = text[max(0, a - _BACK - 1) : b + 4] if b - a < 300 else None
            got = self.known.get((key, a > _BACK)) if key is not None else None
            if got is None:
                got = [(x - a, y - a, t) for x, y, t in decode(self.weights, text, a, b)]
                if len(self.known) > 5_000:
                    self.known.clear()
                if key is not None:
                    self.known[key, a > _BACK] = got
            out += [(a + x, a + y, t) for x, y, t in got]
        return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, t in spans:
        out += [text[at:a], f"[{t}]"]
        at = b
    return "".join(out) + text[at:] if spans else text


def _redact(weights: np.ndarray, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights)
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in textvec.slices(batches, "text"):
            texts = b.column("text").to_pylist()
            spans = [tagger.entities(t) if t else [] for t in texts]
            new = pa.array([t if not s else redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
            if full:
                listed = pa.array([[{"type": t, "start": x, "end": y} for x, y, t in s] for s in spans], kind)
                yield pa.record_batch({"doc_id": b.column("doc_id"), "text": new, "entities": listed})
            else:
                yield pa.RecordBatch.from_arrays([new if f.name == "text" else b.column(i) for i, f in enumerate(b.schema)], names=b.schema.names)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """docs with every entity in text replaced by its type in brackets."""
    return docs.mapInArrow(_redact(train(), False), docs.schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's text with entities replaced by their types, and the entities' places in the original."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(_redact(train(), True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, entities array<struct<type:string,start:int,end:int>>")
