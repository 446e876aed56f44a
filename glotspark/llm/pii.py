"""Keyed surrogates for personal data, in DataFrame expressions only.

Found are e-mail addresses, IPv4 addresses, phone numbers, card numbers, social security numbers,
secret tokens and persons' names: behind forms of address or a listed given name, all capitalised
words that follow, with the initials and particles before them. Names in scripts without case (Han,
Hangul, Kana, Arabic, Hebrew) are not found, nor names without a form of address or a listed given
name. Each match is replaced by a value of its own type:

* letters and digits are substituted one by one, vowel for vowel, consonant for consonant, within
  their script and case, by a shift that a keyed hash of the characters before gives; a second
  pass goes backwards. Undoing it character by character is possible, so the substitution is one
  to one: different values stay different, and one value is replaced alike everywhere. Letters
  outside the listed alphabets are substituted among the letters of their script;
* numbers are substituted on their digits and put back into their own format; a card number keeps
  how far it is from a valid check digit, so valid ones stay valid;
* an IPv4 address is a 32-bit number and goes through a keyed Feistel network, one to one as well;
* forms of address and particles stay; listed given names are permuted within the list of their
  gender and script; other names are substituted letter by letter, and again while the outcome is a
  listed name, which ends after as many rounds as there are listed names of one length;
* every word of a name found anywhere in a text is replaced at each later or earlier mention in that
  text. A word that is a common word too (Will, May, Mark ...) stays where it begins a sentence
  and a word in lower case follows.

Texts are looked through once: what stands between the finds and the finds are kept in a table, the
distinct pairs of value and surrogate in it are checked for collisions, any value whose surrogate
stands for another one as well gets a new surrogate, and the texts are put together from that table.
No shuffle of texts, no Python on the executors.

Defined results: a null text stays null with no entities; an empty one stays empty; texts of any
length are taken whole; repeated rows are replaced alike; where two kinds could match at one place,
the first in KINDS does; an empty table gives an empty one; columns of other names are kept, those
named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotspark.llm.batches import numbered
from glotspark.llm.store import Stash

# Forms of address and given names by gender.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Doña"]
NEUTRAL_TITLES = ["Dr", "Prof"]
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Paul", "Mark", "Peter", "George", "Henry", "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "Jacques", "Michel", "Carlos", "José", "Juan", "Luis", "Miguel", "Mohammed", "Ahmed", "Hassan", "Omar", "Ibrahim", "Wei", "Hiroshi", "Kenji", "Rajesh", "Arjun", "Marco", "Luca", "Giovanni", "Lars", "Sven", "Piotr", "Kevin", "Brian", "Steven"]
FEMALE_NAMES = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Margaret", "Sandra", "Emily", "Anna", "Emma", "Alice", "Ursula", "Monika", "Petra", "Marie", "Sophie", "Camille", "Claire", "Carmen", "María", "Lucía", "Isabel", "Elena", "Fatima", "Aisha", "Leila", "Yasmin", "Mei", "Yuki", "Sakura", "Priya", "Ananya", "Giulia", "Francesca", "Ingrid", "Astrid", "Agnieszka", "Katarzyna", "Olga", "Natalia", "Hannah", "Rebecca"]

# The same in Cyrillic and Greek.
OTHER_TITLES = ["Господин", "господин", "Госпожа", "госпожа", "г-н", "г-жа", "Доктор", "доктор", "Профессор", "профессор", "д-р", "Κύριος", "κύριος", "Κύριο", "κύριο", "Κυρία", "κυρία", "Δρ"]
OTHER_NAMES = [
    ["Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Николай", "Александр", "Михаил", "Андрей", "Владимир"], ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана", "Екатерина"],
    ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Παύλος"], ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα"],
]
#: Words inside names that stay as they are.
PARTICLES = ["van", "von", "vom", "zu", "zur", "der", "den", "ten", "ter", "de", "del", "della", "di", "da", "das", "do", "dos", "du", "des", "la", "las", "los", "le", "y", "e", "bin", "ibn", "al", "el", "af", "av"]

#: Names and words of names that are common words as well.
COMMON = ["Will", "May", "Mark", "Grant", "Rose", "Bill", "Art", "Grace", "Hope", "Faith", "Joy", "April", "June", "August", "Summer", "Dawn", "Drew", "Frank", "Jack", "Pat", "Rich", "Rob", "Sue", "Chance", "Young", "Long", "Little", "Black", "White", "Brown", "Green", "Day", "Love", "Case", "Price", "Field", "Banks", "Hill", "Wood", "Stone", "Page", "West", "North", "Lang", "Klein", "Gross", "Petit", "Grand"]

TITLES = MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES + OTHER_TITLES
GIVEN = [MALE_NAMES, FEMALE_NAMES, *OTHER_NAMES]

_END = r"(?![\p{L}\p{N}])"
_INITIAL = r"(?:\p{Lu}\.-?)+|\p{Lu}"
_NAME = rf"\p{{Lu}}[\p{{L}}'’-]*\p{{Ll}}{_END}"
_TITLES = "|".join(TITLES)
_GIVEN = "|".join(x for names in GIVEN for x in names)
_BEFORE = rf"(?:(?:{_INITIAL}|{'|'.join(PARTICLES)}) )*+"
#: A name's words, as many as there are; each round is taken for good, so that long runs need no stack.
_WORDS = rf"{_BEFORE}{_NAME}(?: (?!(?:{_TITLES})\.? ){_BEFORE}{_NAME})*+"
PERSON = rf"(?=[\p{{Lu}}гдпκ])(?<![\p{{L}}\p{{N}}])(?:(?:(?:{_TITLES})\.? ){{1,4}}{_WORDS}|(?:{_GIVEN}) {_WORDS})"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.)+\p{L}{2,24}(?![\p{L}\p{N}])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])"
TOKEN = r"(?<![\p{L}\p{N}])(?:(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})|(?:sk-|ghp_|AKIA)[A-Za-z0-9]{16,64})(?![\p{L}\p{N}])"

#: In this order: where two could match at one place, the first does.
KINDS = {"email": EMAIL, "ip": IPV4, "ssn": SSN, "token": TOKEN, "card": CARD, "phone": PHONE, "person": PERSON}
#: No kind begins behind a letter or digit, so most places are done with at the first look.
_FOUND = "(?<![\\p{L}\\p{N}])(?:" + "|".join(KINDS.values()) + ")"
#: Every kind but a name has one of these in it; texts without are not looked through any further.
_SIGN = "[0-9@]|[a-fA-F]{32}|sk-|ghp_|AKIA"

# The alphabets within which characters are substituted.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãåèéêëìíîïòóôõùúûýÿäöü", "ñçšžčćđłńśźż", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
HEX = "0123456789abcdef"
#: Ranges of letters without case that are shifted within themselves: Han and its extensions, Hangul, Hiragana, Katakana.
WIDE = [(0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3400, 0x4DB5), (0x20000, 0x2A6D6)]


def script_letters() -> list[str]:
    """The letters outside ALPHABETS and WIDE, grouped by script and by whether they have case.

    From the character database of Unicode 3.2, whose letters every runtime knows alike.
    """
    listed, groups = set("".join(ALPHABETS)), {}
    for code in range(0xAA, 0x10000):
        c = chr(code)
        if any(a <= code <= b for a, b in WIDE) or c in listed or not unicodedata.ucd_3_2_0.category(c).startswith("L"):
            continue
        if c != c.lower():
            continue  # goes by its lower case
        paired = len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c
        groups.setdefault((unicodedata.name(c, "?").split()[0], paired), []).append(c)
    return ["".join(g) for g in groups.values() if len(g) > 1]


def _number(key: str, *parts: Column) -> Column:
    """A keyed hash as a number under 2^40."""
    said = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(said, 256), 1, 10), 16, 10).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shifted(c: Column, shift: Column, hexadecimal: Column) -> Column:
    groups = F.array(*[F.lit(a) for a in [*ALPHABETS, *script_letters()]])

    def body(x: Column) -> Column:
        low, by, up = x["low"], x["shift"], x["low"] != x["c"]
        moved = lambda letters: F.substring(letters, (F.pmod(F.instr(letters, low) - 1 + by, F.length(letters)) + 1).cast("int"), F.lit(1))
        out = F.when(F.contains(F.lit(HEX), low) & x["hex"], moved(F.lit(HEX)))
        for a in ALPHABETS[:3]:  # what nearly all characters are
            out = out.when(F.contains(F.lit(a), low), moved(F.lit(a)))
        code = F.ascii(low)
        for first, last in WIDE:
            new = F.pmod(code - first + by, F.lit(last - first + 1)) + first
            out = out.when(code.between(first, last), F.decode(F.unhex(F.lpad(F.hex(new), 8, "0")), "UTF-32"))
        out = out.when(code < 128, low)
        other = _let(F.filter(groups, lambda g: F.contains(g, low)), lambda g: F.when(F.size(g) > 0, moved(g[0])).otherwise(low))
        return _let(out.otherwise(other), lambda new: F.when(up, F.upper(new)).otherwise(new))

    return _let(F.struct(c.alias("c"), F.lower(c).alias("low"), shift.alias("shift"), hexadecimal.alias("hex")), body)


def substituted(value: Column, key: str, kind: Column, hexadecimal: Column) -> Column:
    """The value with each letter and digit replaced in its alphabet; one to one for values of one shape.

    Two passes, one from each end, by one expression: the string is turned round after each.
    """

    def once(s: Column, way: Column) -> Column:
        each = F.transform(
            F.filter(F.split(s, ""), lambda x: F.length(x) > 0),
            lambda c, i: _shifted(c, _number(key, kind, way, F.lower(F.substring(s, F.lit(1), i))), hexadecimal),
        )
        return F.reverse(F.array_join(each, ""))

    return F.aggregate(F.array(F.lit("on"), F.lit("back")), value, once)


def _formatted(value: Column, digits: Column) -> Column:
    """The digits put in place of those of value, one after the other."""

    def body(v: Column) -> Column:
        def each(c: Column, i: Column) -> Column:
            place = F.length(F.regexp_replace(F.substring(v["value"], F.lit(1), i + 1), "[^0-9]", ""))
            return F.when(c.between("0", "9"), F.substring(v["digits"], place, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(v["value"], ""), lambda x: F.length(x) > 0), each), "")

    return _let(F.struct(value.alias("value"), digits.alias("digits")), body)


def _check_digit(digits: Column) -> Column:
    """What a card number without its last digit needs as such."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.pmod(-F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x), F.lit(10))


def _ip(value: Column, key: str) -> Column:
    def halves(octet: Column) -> Column:
        return F.struct((octet[0] * 256 + octet[1]).alias("l"), (octet[2] * 256 + octet[3]).alias("r"))

    def round_(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.pmod(_number(key, F.lit("ip"), i, s["r"]), F.lit(65536))).alias("r"))

    state = _let(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), halves)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(4)), state, round_)
    return _let(done, lambda d: F.concat_ws(".", *[(F.shiftright(d[h], 8) if high else F.pmod(d[h], F.lit(256))).cast("string") for h in ("l", "r") for high in (True, False)]))


def next_names(key: str) -> dict[str, str]:
    """For each listed given name the one after it in its gender's and script's keyed order."""
    out = {}
    for names in GIVEN:
        order = sorted(names, key=lambda x: hashlib.sha256(f"{key}\x1fgiven\x1f{x}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


#: Rounds after which the substitution of a word has left the listed names: as many as have one length, and one.
_ROUNDS = max(Counter(len(x) for names in GIVEN for x in names).values()) + 1
_KEPT = [t + dot for t in TITLES for dot in ("", ".")] + PARTICLES
_TAIL = {"email": r"\.\p{L}+$"}
_HEAD = {"phone": r"^\+[0-9]{1,3}(?=[ .-])", "token": "^(?:sk-|ghp_|AKIA)?"}


def kind_of(value: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        out = (F.when if out is None else out.when)(value.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return out.otherwise(F.lit("person"))


def surrogate_of(value: Column, kind: Column, key: str) -> Column:
    """What stays (a country code, a key's prefix, the top level domain) is cut off, the rest
    substituted - a name word by word - and all put together again."""
    names = next_names(key)
    listed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    numeric = ["ssn", "card", "phone"]

    def cut(v: Column) -> Column:
        k = v["kind"]
        head = F.when(k == "phone", F.regexp_extract(v["value"], _HEAD["phone"], 0)).when(k == "token", F.regexp_extract(v["value"], _HEAD["token"], 0)).otherwise(F.lit(""))
        tail = F.when(k == "email", F.regexp_extract(v["value"], _TAIL["email"], 0)).otherwise(F.lit(""))
        return _let(F.struct(v["value"].alias("value"), k.alias("kind"), head.alias("head"), tail.alias("tail")), split)

    def split(v: Column) -> Column:
        rest = F.substring(v["value"], F.length(v["head"]) + 1, F.length(v["value"]) - F.length(v["head"]) - F.length(v["tail"]))
        plain = F.when(v["kind"].isin(numeric), F.regexp_replace(rest, "[^0-9]", "")).otherwise(rest)
        return _let(F.struct(v["kind"].alias("kind"), v["head"].alias("head"), v["tail"].alias("tail"), rest.alias("rest"), plain.alias("plain")), atoms)

    def atoms(v: Column) -> Column:
        body = F.when(v["kind"] == "person", F.split(v["plain"], " ")).when(v["kind"] == "card", F.array(F.substring(v["plain"], F.lit(1), F.length(v["plain"]) - 1))).otherwise(F.array(v["plain"]))
        hexadecimal = (v["kind"] == "token") & (v["head"] == "")
        salt = v["kind"]

        def each(a: Column) -> Column:
            # substituted again while the outcome is a listed name: a walk along a cycle of the substitution,
            # which comes to another word before it has met all listed names of this length
            walk = lambda x, i: F.when((i == 1) | ((salt == "person") & x.isin(list(names))), substituted(x, key, salt, hexadecimal)).otherwise(x)
            person = salt == "person"
            return F.when(person & a.isin(_KEPT), a).when(person & a.isin(list(names)), F.element_at(listed, a)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), a, walk))

        return _let(F.struct(*[v[c].alias(c) for c in ("kind", "head", "tail", "rest", "plain")], F.transform(body, each).alias("new")), put)

    def put(v: Column) -> Column:
        new = v["new"][0]
        last = F.substring(v["plain"], F.length(v["plain"]), F.lit(1)).cast("int")
        check = F.pmod(_check_digit(new) + last - _check_digit(F.substring(v["plain"], F.lit(1), F.length(v["plain"]) - 1)), F.lit(10))
        digits = F.when(v["kind"] == "card", F.concat(new, check.cast("string"))).otherwise(new)
        whole = F.when(v["kind"].isin(numeric), _formatted(v["rest"], digits)).otherwise(F.array_join(v["new"], " "))
        return F.concat(v["head"], whole, v["tail"])

    return F.when(kind == "ip", _ip(value, key)).otherwise(_let(F.struct(value.alias("value"), kind.alias("kind")), cut))


def _name_words(text: Column) -> Column:
    """The words of the names found in a text, without titles, particles and initials."""
    words = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), lambda m: F.split(m, " ")))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(_KEPT) & ~w.rlike(f"^(?:{_INITIAL})$")))


#: Where a common word is none of a name: it begins a sentence and goes on in lower case.
_ORDINARY = r"(?<=^|[.!?…:\n]|[.!?…:][ \n\"'“„»)]{1,3})(?:%s)(?= \p{Ll})" % "|".join(COMMON)


def entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with _pattern (what is looked for in this text) and _found: an array of (value, kind, surrogate)."""
    names = F.when(F.col(text).rlike(PERSON), _name_words(F.col(text)))
    quoted = F.array_join(F.transform("_names", lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
    mention = F.concat(F.lit(_FOUND[:-1] + rf"|(?!{_ORDINARY})(?<![\p{{L}}\p{{N}}])(?:"), quoted, F.lit(")(?![\\p{L}\\p{N}]))"))
    pattern = F.when(F.size("_names") > 0, mention).otherwise(F.lit(_FOUND))
    values = F.when(F.col("_names").isNull() & F.col(text).rlike(_SIGN), F.regexp_extract_all(text, F.lit(_FOUND), F.lit(0))).when(F.col("_names").isNotNull(), F.regexp_extract_all(text, F.col("_pattern"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    typed = F.transform("_values", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    full = F.transform("_typed", lambda v: F.struct(v["value"].alias("value"), v["kind"].alias("kind"), surrogate_of(v["value"], v["kind"], key).alias("surrogate")))
    out = docs.withColumn("_names", names).withColumn("_pattern", pattern).withColumn("_values", F.coalesce(values, F.array().cast("array<string>")))
    return out.withColumn("_typed", typed).withColumn("_found", F.when(F.size("_values") > 0, full).otherwise(F.array().cast("array<struct<value:string,kind:string,surrogate:string>>"))).drop("_names", "_values", "_typed")


def _plain(value: Column, kind: Column) -> Column:
    """What makes values of a kind the same: digits of numbers, addresses in lower case."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, "[^0-9+]", "")).when(kind == "email", F.lower(value)).otherwise(value)


def collisions(pairs: DataFrame) -> DataFrame:
    """Of (kind, value, surrogate) the values whose surrogate stands for a smaller value as well: kind, same (the value, plain)."""
    kind = F.col("kind")
    plain = pairs.select("kind", _plain(F.col("value"), kind).alias("same"), _plain(F.col("surrogate"), kind).alias("alike")).distinct()
    first = plain.groupBy("kind", "alike").agg(F.min("same").alias("first"), F.count("*").alias("n")).where("n > 1")
    return plain.join(first, ["kind", "alike"]).where("same <> first").select("kind", "same").distinct()


def replacements(pairs: DataFrame, key: str, stash: Stash, rounds: int = 8) -> DataFrame | None:
    """kind, value, surrogate for the values that need another one than surrogate_of() gives; None where no two collide.

    The substitution is one to one, so there are none unless it is changed; each round gives the
    colliding values a surrogate under a key of its own.
    """
    changed = None
    for k in range(rounds):
        bad = stash.keep(collisions(pairs), f"collisions{k}")
        if bad.isEmpty():
            return changed
        rows = pairs.join(bad, (pairs.kind == bad.kind) & (_plain(pairs.value, pairs.kind) == bad.same), "left").select(pairs.kind, "value", "surrogate", F.col("same").isNotNull().alias("again"))
        new = F.when(F.col("again"), surrogate_of(F.col("value"), F.col("kind"), f"{key}\x1f{k}")).otherwise(F.col("surrogate"))
        pairs = stash.keep(rows.select("kind", "value", new.alias("surrogate"), "again"), f"pairs{k}")
        now = pairs.where("again").select("kind", "value", "surrogate")
        changed = now if changed is None else changed.join(now, ["kind", "value"], "left_anti").unionByName(now)
        pairs = pairs.drop("again")
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def surrogate(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text replaced, n_entities (long) and kinds (array of distinct kinds)."""
    if not key:
        raise ValueError("surrogates need a key")
    stash = Stash(docs.sparkSession, "pii")
    rows, name_of = numbered(docs, [c for c in docs.columns if c not in ("n_entities", "kinds")])
    own = name_of[text]
    found = entities(rows, key, own)
    between = F.when(F.size("_found") > 0, F.split(F.col(own), F.col("_pattern"), -1)).otherwise(F.array(F.col(own)))
    parts = stash.keep(found.select(*[between.alias("_between") if c == own else F.col(c) for c in rows.columns], "_found"), "parts")
    pairs = stash.keep(parts.select(F.explode("_found").alias("e")).select("e.kind", "e.value", "e.surrogate").distinct(), "pairs")
    again = replacements(pairs, key, stash)
    name = lambda kind, value: F.concat(kind, F.lit("\x1f"), value)
    if again is not None:
        told = again.select(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("value")), F.col("surrogate")))).alias("_again"))
        parts = parts.crossJoin(F.broadcast(told))  # one row: the values that collided
    new = lambda e: e["surrogate"] if again is None else F.coalesce(F.try_element_at("_again", name(e["kind"], e["value"])), e["surrogate"])
    joined = F.array_join(F.zip_with("_between", "_found", lambda a, b: F.concat(a, F.coalesce(new(b), F.lit("")))), "")
    whole = F.when(F.size("_found") > 0, joined).otherwise(F.col("_between")[0])
    kinds = F.array_sort(F.array_distinct(F.transform("_found", lambda e: e["kind"])))
    return parts.select(*[(whole if c == text else F.col(n)).alias(c) for c, n in name_of.items()], F.size("_found").cast("long").alias("n_entities"), kinds.alias("kinds"))
