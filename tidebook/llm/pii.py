"""Personal data replaced by surrogates: keyed, of the same type and format, distinct, and the same for the same entity.

A surrogate is a function of a secret key, the entity's kind and normal form, and an attempt number: digits stay
digits, letters stay letters of their script and case, cards keep their check-sum remainder and account numbers a right
one, names come from lists of the title's gender. A surname has one surrogate with any title and given name, and a full
name one given name, so a person stays one person; a full name after a title of neither gender takes the gender it has
elsewhere. A name that a title made known in a text is replaced wherever else it stands there, alone or in full, in
capitals too. All distinct entities of the corpus are checked once: where two share a surrogate, or a surrogate is
itself an entity of the corpus, the later one tries again until no clash is left. Later attempts draw from wider spaces
(longer names, addresses and phone numbers), so that a free one exists however many entities a form has; the nine digits
of an SSN, the check-summed ones of a card or account and the octets of an IP address stay. Texts are rebuilt row by
row; only texts with an entity that needed another attempt take part in a join. DataFrame functions only.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import materialize, read_table, salted_left_join
from tidebook.llm.decontamination import text_key

#: Where a run's secret key is looked for: a session setting, then an environment variable.
KEY_SETTING, KEY_VARIABLE = "spark.tidebook.pii.key", "TIDEBOOK_PII_KEY"
#: The key of the registered queries where none is set. It is no secret: it only serves tables that hold invented people.
QUERY_KEY = "tidebook"
#: Rounds that settle clashes. Spaces widen with the attempts, so more are never needed; a guard against a defect.
MAX_ROUNDS = 60
#: Attempts in one space; the next ones draw from a space that is a part, letter or digit longer.
WIDEN = 2

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Titles of each gender; those of neither stand in the third list. Fixed words of six languages.
TITLES = {
    "f": "Mrs Ms Miss Frau Mme Madame Mlle Mademoiselle Señora Sra Señorita Srta Госпожа госпожа Г-жа г-жа Κυρία κυρία Κα κα".split(),
    "m": "Mr Herr Herrn M Monsieur Señor Sr Sir Господин господин Г-н г-н Κύριος κύριος Κος κος κ".split(),
    "n": "Dr Prof Professor Doctor Доктор доктор Д-р д-р Профессор профессор Проф проф Δρ Καθ".split(),
}
_TITLE = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
#: Titles in capitals, which stand before names in capitals only.
SHOUTED = {"f": "MRS MISS FRAU MME SEÑORA SRA".split(), "m": "MR HERR SEÑOR SR".split(), "n": "DR PROF".split()}
_SHOUTED = "|".join(sorted((t for own in SHOUTED.values() for t in own), key=len, reverse=True))
#: Words between or before the parts of a name; they stay as they are.
PARTICLES = "de da del della di do dos das du la le van von vom der den ter ten zu zur al el bin ibn af av".split()
_WORD = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]+(?:[-'’]\p{Lu}[\p{L}\p{M}]+){0,3}"
_BETWEEN = rf"(?:\p{{Lu}}\.[ ]?){{0,3}}(?:(?:{'|'.join(PARTICLES)})[ ]){{0,3}}"
_NAME = rf"{_BETWEEN}{_WORD}(?:[ ]{_BETWEEN}{_WORD})?"
_CAPITALS = r"\p{Lu}[\p{Lu}\p{M}'’-]+"
_LETTER = r"[\p{L}\p{M}\p{N}_]"
#: Kinds in the order in which they are tried at one place of a text.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,126}",
    "ipv6": rf"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,6}}{_HEX}|(?:{_HEX}:){{1,7}}:)(?![\w:])",
    "ip": rf"(?<![\w.]){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?!\.?\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\w)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.-])[2-9]\d{9}(?![\w-])",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "name": rf"(?<!{_LETTER})(?:(?:(?:{_TITLE})\.?[ ]){{1,3}}{_NAME}|(?:(?:{_SHOUTED})\.?[ ]){{1,2}}{_CAPITALS}(?:[ ]{_CAPITALS})?)",
}
#: One expression for all kinds, none of which begins inside a word. The card's inner group is the only one, so its
#: number holds here too.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: What every text with an entity holds: a cheap look before the expression above.
GATE = rf"@|\d{{3}}|\d\.\d|\+\d|:[0-9A-Fa-f]{{0,4}}:|(?:{_TITLE}|{_SHOUTED})\.?[ ](?:\p{{Lu}}|(?:{'|'.join(PARTICLES)})[ ])"
#: Stands on either side of an entity in a marked text.
_MARK = "\u0001"
#: Given names by gender and parts of surnames by script; a surname takes three parts.
GIVEN = {
    "latin": {"f": "Ada Clara Dora Edith Flora Greta Hanna Irma Julia Karin Laura Marta Nora Olga Paula Rosa".split(), "m": "Albert Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Kurt Leon Martin Noel Otto Peter".split()},
    "cyrillic": {"f": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья".split(), "m": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей".split()},
    "greek": {"f": "Άννα Βάσω Γωγώ Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κλειώ Λίνα Μαρία Νίκη Ξένια Ρένα Σοφία".split(), "m": "Άρης Βασίλης Γιάννης Δήμος Ευάγγελος Ζήσης Ηλίας Θάνος Ιάσων Κώστας Λάμπρος Μάρκος Νίκος Παύλος Σπύρος Τάσος".split()},
}
PARTS = {
    "latin": "bar den fel gor han jul kan lem mor nel pol ran sel tor vin wes".split(),
    "cyrillic": "бар вен гор дал жук зан кол лем мор нел пол ран сел тор фед чер".split(),
    "greek": "βαρ γεν δορ ζαν θελ καν λεμ μορ νελ πολ ραν σελ τορ φιλ χαν ψαλ".split(),
}
#: Ends of surnames, and those that a surname gets whose own end is a woman's.
_ENDS = {"latin": ("", ""), "cyrillic": ("ов", "ова"), "greek": ("ος", "ου")}
_WOMEN = "[ая]$|ου$"


def query_key(spark: SparkSession) -> str:
    """The key that is set, or that of the registered queries."""
    return spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE) or QUERY_KEY


def kind_of(entity: Column) -> Column:
    """The kind of a matched entity, told by its characters: all kinds but names hold digits or an at sign."""
    digits = F.regexp_replace(entity, r"\D", "")
    out = F.when(entity.contains("@"), "email").when(F.length(digits) == 0, "name").when(entity.contains(":"), "ipv6").when(entity.rlike(r"^[A-Z]"), "iban")
    out = out.when(entity.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip").when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    return out.when(entity.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$|^\d{10}$"), "phone").otherwise("card")


def _title(entity: Column) -> Column:
    """The titles before a name, with the blank after them; empty where it stands alone."""
    return F.regexp_extract(entity, rf"^(?:(?:{_TITLE}|{_SHOUTED})\.?[ ])*", 0)


def _name_parts(entity: Column) -> tuple[Column, Column, Column]:
    """What stays before the given name, the given name (empty if there is none), and the last word of a name."""
    title = _title(entity)
    body = F.substring(entity, F.length(title) + 1, F.length(entity))
    first, last = F.substring_index(body, " ", 1), F.substring_index(body, " ", -1)
    given = body.contains(" ") & ~F.lower(first).isin(PARTICLES) & ~first.rlike(r"^\p{Lu}\.")
    return title, F.when(given, first).otherwise(""), last


def _let(value: Column, then) -> Column:
    """then(value), the value being worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sides(address: Column) -> tuple[Column, Column]:
    """The groups of an IPv6 address before and after its gap; without a gap all are before it."""
    groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
    gap = address.contains("::")
    return groups(F.substring_index(address, "::", 1)), F.when(gap, groups(F.substring_index(address, "::", -1))).otherwise(F.array().cast("array<string>"))


def _whole_address(entity: Column) -> Column:
    """An IPv6 address in its one long spelling: eight groups in lower case without leading zeros."""
    left, right = _sides(F.lower(entity))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, F.when(entity.contains("::"), zeros).otherwise(F.array().cast("array<string>")), right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def normal(entity: Column, kind: Column) -> Column:
    """What makes two spellings one entity: digits alone of numbers, lower case of addresses, all groups of IPv6 ones; of
    names given and last one, with one kind of apostrophe."""
    _, given, last = _name_parts(entity)
    name = F.replace(F.lower(F.when(given == "", last).otherwise(F.concat_ws(" ", given, last))), F.lit("’"), F.lit("'"))
    return F.when(kind == "ipv6", _whole_address(entity)).otherwise(_normal_text(entity, kind, name))


def _normal_text(entity: Column, kind: Column, name: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"\D", "")).when(kind == "name", name).when(kind == "iban", F.lower(F.replace(entity, F.lit(" "), F.lit("")))).otherwise(F.lower(entity))


def _bytes(key: str, kind: Column, word: Column, attempt: Column) -> Column:
    """The 32 bytes of the keyed digest of an entity and an attempt, as numbers."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, word, attempt.cast("string")).cast("binary"), 256)
    return _let(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte of a digest, from 0; i wraps at its length and the round is added."""
    return F.get(digest, F.pmod(i, F.lit(32))) + F.floor(i / 32).cast("int")


def _one(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _letter(c: Column, n: Column) -> Column:
    """A lower-case letter for a letter: vowel for vowel, in its own script; other characters stay."""
    out = F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike("[aeiou]"), _one("aeiou", n)).when(c.rlike("[a-z]"), _one("bcdfghklmnprstvwz", n))
    out = out.when(c.rlike(r"\p{IsCyrillic}"), _one("абвгдежзиклмнопрстуфхч", n)).when(c.rlike(r"\p{IsGreek}"), _one("αβγδεζηθικλμνξοπρστυφχψω", n))
    return out.when(c.rlike(r"\p{L}"), _one("aeioubcdfghklmnprstvwz", n)).when(c.rlike(r"\p{N}"), F.pmod(n, F.lit(10)).cast("string")).otherwise(c)


def _luhn(digits: Column) -> Column:
    """The check sum's remainder of a digit string."""

    def add(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: F.pmod(acc["sum"], F.lit(10)))


def _mod97(chars: Column) -> Column:
    """The remainder by 97 of an account number, letters counting from 10."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 87, F.lit(97)))

    return F.aggregate(F.split(chars, ""), F.lit(0), lambda acc, c: add(acc, c).cast("int"))


def _wider(attempt: Column) -> Column:
    """How many parts, letters or digits an attempt's surrogate has beyond its form."""
    return F.floor(attempt / WIDEN).cast("int")


def _more(n: Column, one) -> Column:
    """n pieces in one string; one makes a piece from its number, counted from 10 as places of a digest."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: one(j + 9)), "")).otherwise("")


def _by_script(norm: Column, one) -> Column:
    """one(script) for the script of a name."""
    return F.when(norm.rlike(r"\p{IsCyrillic}"), one("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), one("greek")).otherwise(one("latin"))


def _part(script: str, digest: Column, i: Column) -> Column:
    return F.get(F.array(*map(F.lit, PARTS[script])), F.pmod(_byte(digest, i), F.lit(16)))


def _surname(norm: Column, digest: Column, attempt: Column) -> Column:
    """A surname of the same script."""
    part = lambda script: lambda i: _part(script, digest, i)
    return _by_script(norm, lambda s: F.concat(F.initcap(F.concat(*[part(s)(F.lit(i)) for i in range(1, 5)], _more(_wider(attempt), part(s)))), F.when(norm.rlike(_WOMEN), _ENDS[s][1]).otherwise(_ENDS[s][0])))


def _given(norm: Column, digest: Column, gender: Column, attempt: Column) -> Column:
    """A given name of the same script and gender; later attempts hyphenate a part of growing length to it."""

    def one(script: str) -> Column:
        of = lambda g: F.get(F.array(*map(F.lit, GIVEN[script][g])), F.pmod(_byte(digest, F.lit(0)), F.lit(16)))
        first = F.when((gender == "f") | ((gender == "n") & (F.pmod(_byte(digest, F.lit(9)), F.lit(2)) == 0)), of("f")).otherwise(of("m"))
        return F.concat(first, F.when(_wider(attempt) > 0, F.concat(F.lit("-"), F.initcap(_more(_wider(attempt), lambda i: _part(script, digest, i))))).otherwise(""))

    return _by_script(norm, one)


def _split_name(norm: Column) -> tuple[Column, Column]:
    """The given name, empty in a name of one word, and the surname."""
    return F.when(norm.contains(" "), F.substring_index(norm, " ", 1)).otherwise(""), F.substring_index(norm, " ", -1)


def _by_form(kind: Column, norm: Column, digest: Column, attempt: Column) -> Column:
    """The surrogate of an entity that is no name."""
    host = F.substring_index(norm, ".", -1)  # the last label of an address stays
    body = F.substring(norm, F.lit(1), F.length(norm) - F.length(host))
    each = lambda text, one: F.array_join(F.transform(F.split(text, ""), lambda c, i: _let(_byte(digest, i), lambda n: one(c, i, n))), "")
    number = lambda n: F.pmod(n, F.lit(10)).cast("string")
    extra = _more(_wider(attempt), lambda i: _one("bcdfghklmnprstvw", _byte(digest, i)))
    address = _let(each(body, lambda c, i, n: _letter(c, n)), lambda m: F.concat(F.substring_index(m, "@", 1), extra, F.lit("@"), F.substring_index(m, "@", -1), host))
    digits = each(norm, lambda c, i, n: F.when(i > 0, number(n)).when(c == "0", c).otherwise((F.pmod(n, F.lit(9)) + 1).cast("string")))
    # the last digit counts once in the check sum, so any remainder can be met
    card = _let(F.substring(digits, F.lit(1), F.length(norm) - 1), lambda head: F.concat(head, F.pmod(_luhn(norm) - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string")))
    longer = F.concat(digits, _more(_wider(attempt), lambda i: number(_byte(digest, i))))
    octet = lambda i: (F.pmod(_byte(digest, F.lit(i)), F.lit(254)) + 1).cast("string")
    wide = _wider(attempt) > 0  # later attempts fill every group
    rest = lambda j: F.concat(*[_one("0123456789abcdef", _byte(digest, j * 4 + k)) for k in (1, 2, 3)])
    group = lambda g, j: F.concat(_one("123456789abcdef", _byte(digest, j * 4)), F.substring(rest(j), F.lit(1), F.when(wide, F.lit(3)).otherwise(F.length(g) - 1)))
    groups = F.array_join(F.transform(F.split(norm, ":"), lambda g, j: F.when((g == "0") & ~wide, g).otherwise(group(g, j))), ":")
    inner = each(F.substring(norm, F.lit(5), F.length(norm)), lambda c, i, n: F.when(c.rlike("[0-9]"), number(n)).otherwise(_one("abcdefghijklmnopqrstuvwxyz", n)))
    country = F.substring(norm, 1, 2)
    account = _let(inner, lambda x: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
    return (
        F.when(kind == "email", address)
        .when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
        .when(kind == "ipv6", groups)
        .when(kind == "iban", account)
        .when(kind == "card", card)
        .when(kind == "phone", longer)
        .otherwise(digits)
    )


def surname_for(norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a surname in lower case."""
    return _let(_bytes(key, F.lit("surname"), norm, attempt), lambda digest: _surname(norm, digest, attempt))


def given_for(norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of the given name of a full name in lower case."""
    return _let(_split_name(norm)[0], lambda word: _let(_bytes(key, F.lit("given"), word, attempt), lambda digest: _given(word, digest, gender, attempt)))


def form_for(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of what is no name."""
    return _let(_bytes(key, kind, norm, attempt), lambda digest: _by_form(kind, norm, digest, attempt))


def surrogate(kind: Column, norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity's normal form, itself in normal form (names and addresses of machines as written).

    Names come in two kinds, surname (norm: the surname) and given (norm: the full name, of which only the given name counts).
    """
    return F.when(kind == "surname", surname_for(norm, attempt, key)).when(kind == "given", given_for(norm, gender, attempt, key)).otherwise(form_for(kind, norm, attempt, key))


def _spelled(entity: Column, replacement: Column) -> Column:
    """An address of eight groups with the gap that the entity has, where it falls on zeros, or with its groups' widths."""
    left, right = _sides(entity)
    groups, n, m = F.split(replacement, ":"), F.size(left), F.size(right)
    gap = F.slice(groups, n + 1, F.greatest(F.size(groups) - n - m, F.lit(0)))
    short = F.concat(F.array_join(F.slice(groups, F.lit(1), n), ":"), F.lit("::"), F.array_join(F.slice(groups, F.size(groups) - m + 1, m), ":"))
    wide = F.array_join(F.zip_with(groups, left, lambda g, own: F.lpad(g, F.greatest(F.length(g), F.length(own)), F.lit("0"))), ":")
    return F.when(~entity.contains("::"), wide).when(F.forall(gap, lambda g: g == "0"), short).otherwise(replacement)


def written(entity: Column, kind: Column, replacement: Column) -> Column:
    """A surrogate in the entity's own format: punctuation and blanks of numbers, case of addresses. What is longer stays."""
    chars = F.split(entity, "")
    number = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(replacement, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), "")
    number = F.concat(number, F.substring(replacement, F.length(F.regexp_replace(entity, r"\D", "")) + 1, F.length(replacement)))
    at, more = F.instr(entity, "@") - 1, F.greatest(F.length(replacement) - F.length(entity), F.lit(0))
    place = lambda i: F.when(i < at, i).when(i >= at + more, i - more)  # noqa: E731  where a character stands in the entity
    address = F.array_join(F.transform(F.split(replacement, ""), lambda c, i: F.when(F.get(chars, place(i)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(F.upper(replacement), F.length(F.replace(F.substring(entity, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    loud = lambda own, new: F.when(F.upper(own) == own, F.upper(new)).otherwise(new)
    title, given, last = _name_parts(entity)
    inside = F.length(title) + F.length(given)  # particles and initials stand between this place and the last word
    middle = F.substring(entity, inside + 1, F.length(entity) - inside - F.length(last))
    name = F.concat(title, F.when(given == "", F.lit("")).otherwise(loud(given, F.substring_index(replacement, " ", 1))), middle, loud(last, F.substring_index(replacement, " ", -1)))
    return F.when(kind.isin("phone", "card", "ssn"), number).when(kind == "email", address).when(kind == "name", name).when(kind == "iban", spaced).when(kind == "ipv6", loud(entity, _spelled(entity, replacement))).otherwise(replacement)


def _marked(text: Column, pattern: Column) -> Column:
    """A text in pieces: what stands before the first match, the match, what follows it, the next match ...

    The expression runs once over the text, which gets marks around each match; texts that hold the mark themselves
    are taken apart in two runs.
    """
    once = F.split(F.regexp_replace(text, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    twice = F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda z: F.array(z["gap"], z["match"])))
    return F.when(text.contains(_MARK), F.slice(twice, F.lit(1), F.size(gaps) + F.size(matches))).otherwise(once)


def _gender(entity: Column) -> Column:
    """The gender that the titles before a name tell."""
    words = F.split(F.replace(_title(entity), F.lit("."), F.lit("")), " ")
    has = lambda g: F.arrays_overlap(words, F.array(*map(F.lit, TITLES[g] + SHOUTED[g])))
    return F.when(has("f"), "f").when(has("m"), "m").otherwise("n")


_FOUND = "array<struct<entity:string,kind:string,norm:string,gender:string>>"


def _told(entity: Column) -> Column:
    kind = kind_of(entity)
    return F.struct(entity.alias("entity"), kind.alias("kind"), normal(entity, kind).alias("norm"), F.when(kind == "name", _gender(entity)).otherwise("n").alias("gender"))


def _odd(pieces: Column) -> Column:
    return F.filter(pieces, lambda _, i: i % 2 == 1)


def found_in(text: Column) -> Column:
    """array of (entity, kind, norm, gender), in the order of the text, of what is found by its form or title."""
    return F.transform(_odd(_marked(text, F.lit(ANY))), _told)


def _again(found: Column) -> Column:
    """The expression for a text with names: as before, or a name that a title made known, in full or its last word."""

    def forms(e: Column) -> Column:
        title, _, last = _name_parts(e["entity"])
        own = F.array(F.substring(e["entity"], F.length(title) + 1, F.length(e["entity"])), last)
        own = F.concat(F.transform(own, lambda x: F.replace(x, F.lit("’"), F.lit("'"))), F.transform(own, lambda x: F.replace(x, F.lit("'"), F.lit("’"))))
        return F.concat(own, F.transform(own, F.upper))

    known = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda e: e["kind"] == "name"), forms)))
    longest = F.array_sort(known, lambda a, b: F.when(F.length(a) == F.length(b), F.when(a < b, -1).when(a > b, 1).otherwise(0)).otherwise(F.length(b) - F.length(a)))
    return F.concat(F.lit(f"{ANY}|(?<!{_LETTER})(?:"), F.replace(F.array_join(longest, "|"), F.lit("."), F.lit(r"\.")), F.lit(f")(?!{_LETTER})"))


def _held(docs: DataFrame) -> DataFrame:
    """(key, kind, norm, gender): the distinct entities of each text. Those of a text are deduplicated before the shuffle."""
    text = F.col("text").cast("string")
    each = docs.where(text.rlike(GATE)).select(text_key(text).alias("key"), F.explode(found_in(text)).alias("e"))
    return each.select("key", "e.kind", "e.norm", "e.gender").distinct()


def entities(docs: DataFrame) -> DataFrame:
    """(kind, norm, gender): the distinct entities of all texts."""
    return _held(docs).select("kind", "norm", "gender").distinct()


def _units(found: DataFrame) -> DataFrame:
    """Rows of entities (kind, norm, gender) with names taken apart: the surname, and the full name for the given name."""
    unit = lambda kind, norm, gender: F.struct(kind.alias("kind"), norm.alias("norm"), gender.alias("gender"))
    surname = unit(F.lit("surname"), _split_name(F.col("norm"))[1], F.lit("n"))
    given = unit(F.lit("given"), F.col("norm"), F.col("gender"))
    own = F.when(F.col("kind") != "name", F.array(unit(F.col("kind"), F.col("norm"), F.col("gender")))).when(F.col("norm").contains(" "), F.array(surname, given)).otherwise(F.array(surname))
    rest = [c for c in found.columns if c not in ("kind", "norm", "gender")]
    return found.select(*rest, F.explode(own).alias("u")).select(*rest, "u.*").distinct()


def attempts(known: DataFrame, key: str) -> DataFrame:
    """(kind, norm, gender, shown, attempt) of the units whose surrogate is not that of attempt 0 and their own gender.

    After each round, a unit tries again if its surrogate is one of the corpus or also that of another one that comes
    first; given names are compared within a surname, and only with their own. shown is the gender that a full name after
    a title of neither gender has elsewhere (the first of two). A round's table is written to the shared folder;
    rounds end as soon as nothing clashes.
    """
    units = materialize(_units(known), "units")
    titled = units.where("kind = 'given' and gender <> 'n'").groupBy("kind", "norm").agg(F.min("gender").alias("titled"))
    genders = units.join(titled, ["kind", "norm"], "left").select("kind", "norm", "gender", F.when(F.col("gender") == "n", F.coalesce("titled", "gender")).otherwise(F.col("gender")).alias("shown"))
    genders = materialize(genders, "genders")
    now = materialize(genders.select("kind", "norm", F.col("shown").alias("gender")).distinct().withColumn("attempt", F.lit(0)), "attempts")
    given, surname = _split_name(F.col("norm"))
    for _ in range(MAX_ROUNDS):
        named = now.withColumn("surrogate", F.lower(surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("attempt"), key)))
        named = materialize(named.withColumn("reached", F.when(F.col("kind") == "given", F.concat_ws(" ", "surrogate", surname)).otherwise(F.col("surrogate"))), "named")
        first = named.groupBy("kind", "reached").agg(F.min(F.struct("attempt", "norm", "gender")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = named.join(first, ["kind", "reached"]).where(F.struct("attempt", "norm", "gender") != F.col("first")).select("kind", "norm", "gender")
        real = now.where("kind <> 'given'").select("kind", F.col("norm").alias("reached")).distinct()
        taken = named.join(real, ["kind", "reached"], "left_semi").select("kind", "norm", "gender")
        itself = named.where((F.col("kind") == "given") & (F.col("surrogate") == given)).select("kind", "norm", "gender")
        clashing = materialize(shared.union(taken).union(itself).distinct(), "clashing")
        if clashing.isEmpty():
            done = genders.join(now.withColumnRenamed("gender", "shown"), ["kind", "norm", "shown"])
            return done.where("attempt > 0 or shown <> gender").select("kind", "norm", "gender", "shown", "attempt")
        again = now.join(clashing.withColumn("again", F.lit(1)), ["kind", "norm", "gender"], "left")
        now = materialize(again.select("kind", "norm", "gender", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), "attempts")
    raise RuntimeError("surrogates keep clashing: there are more entities of a kind than its fixed format can tell apart")


def _rewritten(docs: DataFrame, key: str) -> DataFrame:
    """(row, found, text): each row of docs, its entities, and its text with surrogates."""
    held = materialize(_held(docs), "entities")
    retried = materialize(attempts(held.select("kind", "norm", "gender").distinct(), key), "retried")
    own = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("text"), text_key(own).alias("key"))
    if retried.isEmpty():
        rows = rows.withColumn("tries", F.lit(None).cast("map<string,struct<attempt:int,shown:string>>"))
    else:
        tries = _units(held).join(retried, ["kind", "norm", "gender"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "gender", "norm"), F.struct("attempt", "shown")))).alias("tries"))
        beside = [F.col("row")[c] for c in docs.columns if c != "text"]  # copies of one text are told apart, and dealt, by these
        rows = salted_left_join(rows, materialize(tries, "tries"), "key", F.xxhash64(*beside) if beside else F.lit(0))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("pieces", F.when(F.col("text").rlike(GATE), _marked(F.col("text"), F.lit(ANY))).otherwise(none))
    rows = rows.withColumn("first", F.transform(_odd(F.col("pieces")), _told))
    named = F.exists("first", lambda e: e["kind"] == "name")
    rows = rows.withColumn("pieces", F.when(named, _marked(F.col("text"), _again(F.col("first")))).otherwise(F.col("pieces")))

    def gendered(e: Column) -> Column:
        """A name without a title is that of the first title that it has in the text."""
        same = F.filter("first", lambda f: (f["kind"] == "name") & (f["norm"] == e["norm"]))
        gender = F.when((e["kind"] == "name") & (_title(e["entity"]) == ""), F.coalesce(F.get(same, F.lit(0))["gender"], e["gender"])).otherwise(e["gender"])
        return F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), e["norm"].alias("norm"), gender.alias("gender"))

    rows = rows.withColumn("found", F.when(named, F.transform(F.transform(_odd(F.col("pieces")), _told), gendered)).otherwise(F.col("first")))

    def tried(kind: Column, norm: Column, gender: Column, then) -> Column:
        """then(gender, attempt) as they are after clashes."""
        one = F.try_element_at(F.col("tries"), F.concat_ws("|", kind, gender, norm))
        return _let(one, lambda t: then(F.coalesce(t["shown"], gender), F.coalesce(t["attempt"], F.lit(0))))

    def whole(e: Column) -> Column:
        norm = e["norm"]
        surname = _let(_split_name(norm)[1], lambda last: tried(F.lit("surname"), last, F.lit("n"), lambda _, n: surname_for(last, n, key)))
        given = F.when(norm.contains(" "), F.concat(tried(F.lit("given"), norm, e["gender"], lambda g, n: given_for(norm, g, n, key)), F.lit(" "))).otherwise("")
        return F.when(e["kind"] == "name", F.concat(given, surname)).otherwise(tried(e["kind"], norm, e["gender"], lambda _, n: form_for(e["kind"], norm, n, key)))

    made = F.transform("found", lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), whole(e).alias("made")))
    new = F.transform(made, lambda e: written(e["entity"], e["kind"], e["made"]))
    gaps = F.filter("pieces", lambda _, i: i % 2 == 0)
    rebuilt = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(new, F.slice(gaps, F.lit(2), F.size(gaps)), lambda s, gap: F.concat(s, gap)), ""))
    return rows.select("row", "found", F.when(F.size("found") > 0, rebuilt).otherwise(F.col("text")).alias("text"))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with all personal data replaced in text; all columns, whatever their names, as before.

    Null texts stay null, empty ones empty. Equal entities get equal surrogates in every row, different ones different
    surrogates, names that share a surname share its surrogate, and spellings of an address of the net's sixth version are
    one entity. A given name alone is not told to be the same. Repeated rows each get a row; columns beside
    text are left alone.
    """
    return _rewritten(docs, key).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, kinds): the new text, and the kinds of its entities, sorted, one for each."""
    found = _rewritten(docs.select("doc_id", "text"), key)
    return found.select("row.doc_id", "text", F.size("found").cast("long").alias("n_entities"), F.array_sort(F.transform("found", lambda e: e["kind"])).alias("kinds"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(read_table(spark, sf_dir, "documents"), query_key(spark))
    return found.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))
