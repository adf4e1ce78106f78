"""Plain versions of operators that SQL can't express, written from their docstrings and sharing no code with them but tables and patterns."""

from __future__ import annotations

import base64
import bz2
import collections
import gzip
import hashlib
import lzma
import math
import re
import zlib
from html.parser import HTMLParser
from urllib.parse import unquote

import regex
import zstandard

from quillsift.llm import html_extract, quality_rules, secrets, toxicity, weak_labels

# -- quality classifier


def votes(text: str | None) -> int:
    """The code of the nine votes on a text."""
    t = text or ""
    n, gone = len(t), lambda p: sum(len(m) for m in regex.findall(p, t))
    letters, upper, blanks = gone(r"\p{L}+"), gone(r"\p{Lu}+"), gone(r"[ \t\n\x0B\f\r]+")
    ws = [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
    nw, kinds = len(ws), len(set(ws))
    known = {w for words in quality_rules.WORDS.values() for w in words}
    common = sum(w in known for w in ws)
    again, near = (sum(a == b for a, b in zip(ws, ws[k:])) for k in (1, 2))
    symbols, bars = gone(r"[#$%&*|@~^<>{}\[\]\\_=+]+"), gone(r"[|\t;]+")
    runs = len(regex.findall(r"[^\p{L}\p{N} \t\n\x0B\f\r]{2,}", t))
    log = lambda x: math.log(x) if x else -math.inf
    rules = [
        (letters >= 40, upper > 0.5 * letters, upper < 0.15 * letters), (n >= 100, symbols > 0.03 * n, symbols < 0.003 * n), (nw >= 20, bars > 0.1 * nw, bars == 0),
        (nw >= 30, log(kinds) < 0.7 * log(nw), log(kinds) > 0.8 * log(nw)), (nw >= 30, again > 0.1 * nw, again < 0.01 * nw),
        (nw >= 30, common < 0.1 * nw, common > 0.2 * nw), (n >= 100, letters < 0.85 * (n - blanks), letters > 0.92 * (n - blanks)),
        (nw >= 20, runs > 0.1 * nw, runs < 0.02 * nw), (nw >= 30, near > 0.15 * nw, near < 0.05 * nw),
    ]
    code = 0
    for needs, bad, good in rules:
        code = code * 3 + (weak_labels.ABSTAIN if not needs else weak_labels.BAD if bad else weak_labels.GOOD if good else weak_labels.ABSTAIN)
    return code


def posteriors(codes: list[int], rounds: int = 500) -> dict[int, float]:
    """code -> probability of good, by EM over single documents."""
    m = len(weak_labels.LABELLERS)
    each = {c: [c // 3 ** (m - 1 - k) % 3 for k in range(m)] for c in codes}
    count = collections.Counter(codes)
    post = {}
    for c, v in each.items():
        good, bad = v.count(2), v.count(0)
        post[c] = min(max(0.5 + (good - 2 * bad) / (2 * max(good + bad, 1)), 0.05), 0.95)
    for _ in range(rounds):
        w = {True: {c: count[c] * p for c, p in post.items()}, False: {c: count[c] * (1 - p) for c, p in post.items()}}
        whole = sum(w[True].values()) + sum(w[False].values()) + 2
        share = {k: (sum(x.values()) + 1) / whole for k, x in w.items()}
        hit = {}
        for k, right, wrong in ((True, 2, 0), (False, 0, 2)):
            for i in range(m):
                r = sum(x for c, x in w[k].items() if each[c][i] == right) + 1
                hit[k, i] = r / (r + sum(x for c, x in w[k].items() if each[c][i] == wrong) + 1)
        new = {}
        for c, v in each.items():
            log = {k: math.log(share[k]) for k in (True, False)}
            for i, x in enumerate(v):
                if x != 1:
                    log[True] += math.log(hit[True, i] if x == 2 else 1 - hit[True, i])
                    log[False] += math.log(hit[False, i] if x == 0 else 1 - hit[False, i])
            new[c] = 1 / (1 + math.exp(min(max(log[False] - log[True], -700), 700)))
        done = max((abs(new[c] - post[c]) for c in new), default=0) < 1e-9
        post = new
        if done:
            break
    return post


# -- toxicity


def mined(rows: list[tuple[str, bool]]) -> dict[str, float]:
    """Words that set the toxic apart among distinct (text, toxic)."""
    k, r = collections.Counter(), collections.Counter()
    rows = sorted(set(rows))
    n, m = sum(b for _, b in rows), sum(not b for _, b in rows)
    for text, bad in rows:
        (k if bad else r).update(set(regex.findall(r"[\p{L}\p{N}]{4,}", text.lower())))
    out = {}
    for w in k:
        a, b = k[w], r[w]
        p, ratio = (a + b) / (n + m), ((a + 0.5) / (n + 1)) / ((b + 0.5) / (m + 1))
        part = lambda x, e: x * math.log(x / e) if x else 0.0
        g2 = 2 * (part(a, n * p) + part(n - a, n * (1 - p)) + part(b, m * p) + part(m - b, m * (1 - p)))
        if a * m > b * n and g2 >= toxicity.MIN_G2 and ratio >= toxicity.MIN_RATIO:
            out[w] = round(min(math.log10(ratio), 2.0), 3)
    return out


def toxic_score(text: str | None, lexicon: dict[str, float]) -> tuple[float, int]:
    """Score and number of matches: every entry is looked for at every place."""
    if not text:
        return 0.0, 0
    t = toxicity.fold(text)
    inside = lambda i: 0 <= i < len(t) and (t[i].isalnum() or t[i] == "_")

    def places(key: str) -> list[tuple[int, int]]:
        at, out = t.find(key), []
        while at >= 0:
            if not inside(at - 1) and not inside(at + len(key)):
                out.append((at, at + len(key)))
            at = t.find(key, at + 1)
        return out

    weights: dict[str, float] = {}
    for word, weight in lexicon.items():
        weights[toxicity.fold(word)] = max(weight, weights.get(toxicity.fold(word), 0.0))
    spared = [p for e in toxicity.EXCEPTIONS for p in places(toxicity.fold(e))]
    found = [(*p, w) for key, w in weights.items() if key not in {toxicity.fold(e) for e in toxicity.EXCEPTIONS} for p in places(key)]
    found = [f for f in found if not any(s <= f[0] and f[1] <= e for s, e in spared)]
    total, n, end = 0.0, 0, 0
    for a, b, w in sorted(found, key=lambda f: (f[0], -f[1])):
        if a >= end:
            total, n, end = total + w, n + 1, b
    if not n:
        return 0.0, 0
    return round(total * toxicity.PER_WORDS / max(toxicity.LEAST_WORDS, len(regex.findall(r"\w+", text))), 6), n


# -- secrets

_PACKED = [gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress, lambda d: zstandard.ZstdDecompressor().decompressobj().decompress(d)]


def _text(data: bytes) -> str | None:
    try:
        s = data.decode()
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\r\n\t" for c in s) >= 0.95 * len(s) else None


def _layers(s: str) -> set[str]:
    """All that one step of decoding gives."""
    out = {unquote(s, errors="replace")} if "%" in s else set()
    if "\\" in s:
        out.add(re.sub(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})", lambda m: chr(min(int(next(g for g in m.groups() if g), 16), 0x10FFFF)), s))
    for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", s):
        run = m[0]
        cuts = [0, *(k + 1 for k, c in enumerate(run) if c in "/_-")]
        parts = {run[a:b] for a in cuts for b in [len(run), *(c - 1 for c in cuts if c > a)]}
        for part in parts:
            body = part.rstrip("=").replace("-", "+").replace("_", "/")
            if len(part) < 16 or len(body) % 4 == 1:
                continue
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            for unpack in (lambda d: d, *_PACKED):
                try:
                    got = _text(unpack(data))
                except Exception:
                    continue
                if got:
                    out.add(got)
    return out - {s}


def secrets_in(text: str | None) -> set[tuple[str, str]]:
    """(rule, digest) of all secrets in a text and in all that it decodes to."""
    seen, work, out = set(), [text] if text else [], set()
    while work:
        s = work.pop()
        if s in seen:
            continue
        seen.add(s)
        work += _layers(s)
        for name, pattern in secrets.RULES.items():
            for m in re.finditer(pattern, s):
                value = m.groupdict().get("value") or m[0]
                if "value" in m.groupdict():
                    share = [value.count(c) / len(value) for c in set(value)]
                    if -sum(p * math.log2(p) for p in share) < 3.0 or not any(c.isdigit() for c in value):
                        continue
                out.add((name, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:16]))
    return out


# -- HTML


class _Lines(HTMLParser):
    """The lines of a well-formed page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.unseen = [""], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "svg", "head", "nav", "footer"):
            self.unseen += 1
        if tag in html_extract._BLOCKS.split("|") or re.fullmatch("h[1-6]|head|body|html|title", tag):
            self.text.append("")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "svg", "head", "nav", "footer"):
            self.unseen -= 1
        self.handle_starttag("br" if tag not in ("a", "b", "i", "em", "strong", "span", "u", "code", "small", "sup", "sub", "label") else "i", [])

    def handle_data(self, data):
        if not self.unseen:
            self.text[-1] += data


def main_text(page: str) -> str:
    """Surge and dive over blocks that are summed one by one."""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    lines = [" ".join(s.split()) for s in parser.text]
    size = [len(s) if len(s) >= html_extract.LINE or (len(s) > 1 and re.search(r"[.!?…]['\"”»)]*$", s)) else 0 for s in lines]
    block = [sum(size[i : i + html_extract.WINDOW]) for i in range(len(lines))]
    out, i = [], 0
    while i < len(lines):
        if block[i] > html_extract.SURGE and 0 not in block[i + 1 : i + 3]:
            end = next((j + 1 for j in range(i + 1, len(lines)) if block[j] == 0 or block[j + 1 : j + 2] == [0]), len(lines))
            kept = [s for s in lines[i:end] if s]
            if sum(map(len, kept)) >= html_extract.LEAST:
                out.append("\n".join(kept))
            i = end
        else:
            i += 1
    return "\n".join(out)

