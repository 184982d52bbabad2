"""Surrogates by brute force: every place of a text against every kind, and one dictionary of attempts, in plain Python."""

from __future__ import annotations

import hashlib

import regex

from tidebook.llm import pii

_plain = lambda p: p.replace(r"[\w", "[A-Za-z0-9_").replace(r"\w", "[A-Za-z0-9_]").replace(r"\d", "[0-9]")  # noqa: E731  as the JVM reads them
KINDS = {k: regex.compile("(?<![A-Za-z0-9])(?:" + _plain(p) + ")") for k, p in pii.KINDS.items()}
LETTERS = {t: g for own in (pii.TITLES, pii.SHOUTED) for g, ts in own.items() for t in ts}


def parts_of(entity):
    """(titles with their blank, what follows): titles are taken off one by one."""
    at = 0
    while (m := regex.compile(r"([^\s.]+)\.? ").match(entity, at)) and m[1] in LETTERS:
        at = m.end()
    return entity[:at], entity[at:]


def name_of(entity):
    """(given or '', last, the place of the last word) of a name."""
    title, body = parts_of(entity)
    words = body.split(" ")
    has = len(words) > 1 and words[0].lower() not in pii.PARTICLES and not regex.match(r"\p{Lu}\.", words[0])
    return words[0] if has else "", words[-1]


def groups_of(address):
    """(groups before the gap, groups after it)."""
    left, gap, right = address.partition("::")
    return [g for g in left.split(":") if g], [g for g in right.split(":") if g]


def normal(kind, entity):
    if kind == "ipv6":
        left, right = groups_of(entity.lower())
        gap = ["0"] * max(0, 8 - len(left) - len(right)) if "::" in entity else []
        return ":".join(g.lstrip("0") or "0" for g in left + gap + right)
    if kind in ("phone", "card", "ssn"):
        return regex.sub(r"[^0-9]", "", entity)
    if kind == "name":
        given, last = name_of(entity)
        return f"{given} {last}".strip().lower().replace("’", "'")
    return entity.replace(" ", "").lower() if kind == "iban" else entity.lower()


def gender(entity):
    told = [LETTERS[t] for t in parts_of(entity)[0].replace(".", "").split()]
    return "f" if "f" in told else "m" if "m" in told else "n"


def scan(text, forms=()):
    """[(start, end, kind, entity)], the leftmost first, kinds in their order, then known names, the longest first."""
    out, at = [], 0
    while at < len(text):
        hit = next(((m.end(), k) for k, p in KINDS.items() if (m := p.match(text, at))), None)
        if hit is None and (at == 0 or not regex.match(r"[\p{L}\p{M}\p{N}_]", text[at - 1])):
            hit = next(((at + len(f), "name") for f in forms if text.startswith(f, at) and not regex.match(r"[\p{L}\p{M}\p{N}_]", text[at + len(f) : at + len(f) + 1])), None)
        if hit is None:
            at += 1
        else:
            out.append((at, hit[0], hit[1], text[at : hit[0]]))
            at = hit[0]
    return out


def found(text):
    """[(start, end, kind, norm, gender, entity)] with later mentions of names."""
    first = scan(text)
    forms = set()
    for *_, kind, e in first:
        if kind == "name":
            body = parts_of(e)[1]
            own = {x.replace(a, b) for x in (body, body.split(" ")[-1]) for a, b in ("’'", "'’")}
            forms |= own | {x.upper() for x in own}
    genders = {}
    for *_, kind, e in first:
        if kind == "name":
            genders.setdefault(normal(kind, e), gender(e))
    out = []
    for a, b, kind, e in scan(text, sorted(forms, key=lambda f: (-len(f), f))) if forms else first:
        norm = normal(kind, e)
        g = "n" if kind != "name" else gender(e) if parts_of(e)[0] else genders.get(norm, "n")
        out.append((a, b, kind, norm, g, e))
    return out


def luhn(digits):
    return sum((d := int(c)) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10


def surrogate(kind, norm, g, attempt, key):
    word = norm.split(" ")[0] if kind == "given" else norm
    digest = hashlib.sha256(f"{key}|{kind}|{word}|{attempt}".encode()).hexdigest()
    byte = lambda i: int(digest[2 * (i % 32) :][:2], 16) + i // 32
    wide = attempt // pii.WIDEN
    more = lambda one: "".join(one(j + 9) for j in range(1, wide + 1))
    script = "cyrillic" if regex.search(r"\p{IsCyrillic}", norm) else "greek" if regex.search(r"\p{IsGreek}", norm) else "latin"
    part = lambda i: pii.PARTS[script][byte(i) % 16]

    def letter(c, n):
        for pattern, letters in (("[0-9]", "0123456789"), ("[aeiou]", "aeiou"), ("[a-z]", "bcdfghklmnprstvwz"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхч"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{L}", "aeioubcdfghklmnprstvwz"), (r"\p{N}", "0123456789")):
            if regex.match(pattern, c):
                return letters[n % len(letters)]
        return c

    if kind == "email":
        head, host = norm.rsplit(".", 1)
        mapped = "".join(letter(c, byte(i)) for i, c in enumerate(head + "."))
        a, b = mapped.split("@", 1)
        return a + more(lambda i: "bcdfghklmnprstvw"[byte(i) % 16]) + "@" + b + host
    if kind == "ip":
        return ".".join(str(byte(i) % 254 + 1) for i in range(4))
    if kind == "ipv6":
        group = lambda g, j: "123456789abcdef"[byte(4 * j) % 15] + "".join("0123456789abcdef"[byte(4 * j + k) % 16] for k in (1, 2, 3))[: 3 if wide else len(g) - 1]
        return ":".join(g if g == "0" and not wide else group(g, j) for j, g in enumerate(norm.split(":")))
    if kind == "iban":
        inner = "".join(str(byte(i) % 10) if c.isdigit() else chr(97 + byte(i) % 26) for i, c in enumerate(norm[4:]))
        check = 98 - int("".join(str(int(c, 36)) for c in inner + norm[:2] + "00")) % 97
        return f"{norm[:2]}{check:02}{inner}"
    if kind == "surname":
        end = {"latin": ("", ""), "cyrillic": ("ов", "ова"), "greek": ("ος", "ου")}[script][bool(regex.search("[ая]$|ου$", norm))]
        return "".join(part(i) for i in range(1, 5)).capitalize() + more(part) + end
    if kind == "given":
        sex = "f" if g == "f" or (g == "n" and byte(9) % 2 == 0) else "m"
        return pii.GIVEN[script][sex][byte(0) % 16] + (f"-{more(part).capitalize()}" if wide else "")
    digits = "".join((("0" if c == "0" else str(byte(i) % 9 + 1)) if i == 0 else str(byte(i) % 10)) for i, c in enumerate(norm))
    if kind == "card":
        return digits[:-1] + str((luhn(norm) - luhn(digits[:-1] + "0")) % 10)
    return digits + (more(lambda i: str(byte(i) % 10)) if kind == "phone" else "")


def units_of(kind, norm, g):
    if kind != "name":
        return [(kind, norm, g)]
    return [("surname", norm.split(" ")[-1], "n")] + ([("given", norm, g)] if " " in norm else [])


def settled(texts, key):
    """{(kind, norm, gender): surrogate} of all units of all texts."""
    units = {u for t in texts for a, b, kind, e in scan(t or "") for u in units_of(kind, normal(kind, e), gender(e) if kind == "name" else "n")}
    shown = {}
    for kind, norm, g in units:
        told = min((h for k, n, h in units if k == kind == "given" and n == norm and h != "n"), default=None)
        shown[kind, norm, g] = (told or g) if g == "n" else g
    attempt = {(k, n, s): 0 for (k, n, _), s in shown.items()}
    real = {(k, n) for k, n, _ in attempt if k != "given"}
    while True:
        made = {u: surrogate(*u, attempt[u], key).lower() for u in attempt}
        reached = {u: f"{made[u]} {u[1].split(' ')[-1]}" if u[0] == "given" else made[u] for u in attempt}
        first = {}
        for u in attempt:
            place = (u[0], reached[u])
            first[place] = min(first.get(place, (attempt[u], *u[1:])), (attempt[u], *u[1:]))
        again = [u for u in attempt if (attempt[u], *u[1:]) != first[u[0], reached[u]] or (u[0], reached[u]) in real or (u[0] == "given" and made[u] == u[1].split(" ")[0])]
        if not again:
            return {k: surrogate(k[0], k[1], s, attempt[k[0], k[1], s], key) for k, s in shown.items()}
        for u in again:
            attempt[u] += 1


def written(kind, entity, new):
    if kind in ("phone", "card", "ssn"):
        left = iter(new)
        return "".join(next(left) if c in "0123456789" else c for c in entity) + "".join(left)
    if kind == "iban":
        left = iter(new.upper())
        return "".join(c if c == " " else next(left) for c in entity)
    if kind == "email":
        at, more = entity.index("@"), max(0, len(new) - len(entity))
        place = lambda i: i if i < at else i - more if i >= at + more else None
        return "".join(c.upper() if (p := place(i)) is not None and p < len(entity) and regex.match(r"\p{Lu}", entity[p]) else c for i, c in enumerate(new))
    loud = lambda own, made: made.upper() if own.upper() == own else made
    if kind == "name":
        title, body = parts_of(entity)
        given, last = name_of(entity)
        middle = body[len(given) : len(body) - len(last)]
        return title + (loud(given, new.split(" ")[0]) if given else "") + middle + loud(last, new.split(" ")[-1])
    if kind == "ipv6":
        (left, right), own = groups_of(entity), new.split(":")
        if "::" not in entity:
            new = ":".join(g.rjust(len(o), "0") for g, o in zip(own, left))
        elif all(g == "0" for g in own[len(left) : len(own) - len(right)]):
            new = ":".join(own[: len(left)]) + "::" + ":".join(own[len(own) - len(right) :])
        return loud(entity, new)
    return new


def replaced(texts, key):
    known, out = settled(texts, key), []
    for text in texts:
        if not text:
            out.append(text)
            continue
        new, at = [], 0
        for a, b, kind, norm, g, e in found(text):
            made = " ".join(known[u] for u in reversed(units_of(kind, norm, g)))
            new += [text[at:a], written(kind, e, made)]
            at = b
        out.append("".join(new) + text[at:])
    return out
