"""Personal data replaced by keyed surrogates of the same kind and format.

Entities are found by one alternation of patterns. Mentions are led back to canonical entities (digits of
cards and phones, addresses in lower case, secret values without the name before them, parts of names
without the form of address); each gets one surrogate, a keyed digest, and each mention spells it in its
own format, so every mention, in whatever document and spelling, agrees (coreference). A global check keeps surrogates distinct: one that another entity took, or that is
itself an entity of the corpus, is drawn anew with the next counter until none clashes. Everything is
DataFrame functions: no Python runs on the executors.

Kinds and what is kept: email (separators, the last label of the host, the last two of public mail hosts; one
surrogate a host), ipv4 (four octets; private and loopback ranges), ipv6 (groups), card (length, grouping, first digit; the check
digit is made valid; unbroken runs of 13 to 19 digits count only with a valid one), phone (punctuation, country code; +cc, 3-3-4,
and national French, German and Spanish forms), ssn, iban (country, grouping; valid check digits), access keys and service tokens (prefix), bearer
tokens, private key blocks (their first and last line), assigned secrets such as password=... (the name before the value),
hexadecimal digests, and names behind a form of address (the form, hence the gender; script; number of names). A full name
that stands behind a form of address anywhere in the corpus is replaced where it stands without one, too.

A value after a colon and without quotes is a secret only if it mixes classes of characters: "secret: nobody knows" stays.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_paths

FEMALE = ("Mrs", "Ms", "Miss", "Mme", "Mlle", "Frau", "Señora", "Sra", "г-жа", "госпожа")
MALE = ("Mr", "Herr", "Señor", "Sr", "г-н", "господин")
#: These tell no gender: given names get an end that shows none, Cyrillic family names that of their own end.
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "д-р", "проф", "профессор", "доктор")
_ADDRESS = "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Letters of all scripts (by ranges, which cost less than a class of letters), digits and signs of a mail box.
_LOCAL = r"A-Za-z0-9._%+\-\x{C0}-\x{1FFF}\x{3040}-\x{FFDF}"
_NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ ]{0,3}"
_ASSIGNED = rf"{_NAMED}[=:][ ]{{0,3}}"
_QUOTED = r"\"(?=[^\"\r\n]{6})[^\"\\\r\n]*+(?:\\.[^\"\\\r\n]*+)*+(?=\")|'(?=[^'\r\n]{6})[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+(?=')"
_OPEN = r"[\"']?[^\s\"']\S{4,}[^\s.,;:)\]}>\"']"
_MIXED = r"(?=\S*(?:[0-9_+=$@#%^&*~]|[a-z][A-Z]))"
#: Kinds whose surrogate keeps what stands before the value.
HEADS = {"bearer": r"^(Bearer )", "pem": r"^(-----BEGIN [A-Z ]{1,40}-----)", "service": r"^((?:[spr]k_(?:live|test)_|gh[pousr]_|xox[abeprs]-))"}

#: In order: where two could start at the same place, the first one is taken. A pattern that begins with
#: an open run of characters looks back first, so that a run is tried once and not from each of its characters.
KINDS: dict[str, str] = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++@(?:[\p{{L}}0-9-]{{1,63}}\.){{1,8}}\p{{L}}{{2,24}}",
    "pem": r"-----BEGIN [A-Z ]{1,40}-----[^-]*+-----END [A-Z ]{1,40}-----",
    "bearer": r"(?<![A-Za-z0-9])Bearer [A-Za-z0-9._~+/-]{10,}+=*+",
    "service": r"(?<![A-Za-z0-9])(?=[gprsx])(?:[spr]k_(?:live|test)_[0-9A-Za-z]{10,}+|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abeprs]-[A-Za-z0-9-]{10,}+)",
    "secret": rf"(?<![A-Za-z0-9])(?=[AaPpSsTt]){_NAMED}(?:[=:][ ]{{0,3}}(?:{_QUOTED})|=[ ]{{0,3}}{_OPEN}|:[ ]{{0,3}}{_MIXED}{_OPEN})",
    "akia": r"(?<![A-Za-z0-9])A(?:KIA|SIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{1,4}:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:([ -]?)[0-9]{4})(?:\1[0-9]{4}){2}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "run": r"(?<![0-9A-Za-z_.+-])[3-6][0-9]{12,18}(?![0-9A-Za-z_])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?=[0-9+(])(?<![0-9+(])(?<!(?i:order|part|item|invoice|serial)(?: (?i:number|no\.?|nr\.?))?[ :#]{1,3})(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}|\+[1-9](?:[ .()/-]{0,2}[0-9]){6,14}|(?<![A-Za-z_.:/=,-])(?:[2-9][0-9]{9}|0[1-9][0-9]{8}|0[1-9](?:[ .][0-9]{2}){4}|0[1-9][0-9]{1,4}[ /][0-9]{5,8}|[6-9][0-9]{2}(?: [0-9]{2}){3})(?![A-Za-z_]|[.,][0-9]))(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|[0-9a-f]{32}|[0-9a-f]{64})(?![A-Za-z0-9])",
    "name": rf"(?=[DFHMPSгдп])(?<![\p{{L}}])(?:{_ADDRESS})\.? \p{{Lu}}[\p{{L}}'’-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'’-]{{1,40}})?",
}
#: Words with capitals, one behind the other: where names without a form of address are looked for.
CAPITALS = r"(?<!\p{L})\p{Lu}[\p{L}'’-]{1,40}+(?: \p{Lu}[\p{L}'’-]{1,40}+)++"
#: No entity begins behind a letter of A to Z but those that begin so: most places of a text are passed over by this alone.
PATTERN = "(?:(?<![A-Za-z])|(?=[0-9+(-]))(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
SECRET_HEAD = rf"^({_ASSIGNED}[\"']?)"
#: Country codes of one and two digits; the others have three.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Hosts of documentation and of public mail, which name nobody; of other hosts the last label alone is kept.
SHARED_HOSTS = ("example.com", "example.org", "example.net", "gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "gmx.de", "web.de", "orange.fr", "mail.ru")
#: Draws before a surrogate is made distinct by a digest at its end.
TRIES = 12
#: Replacement lists of at most this many bytes are broadcast to the texts; beyond, texts are dealt by key.
BROADCAST_BYTES = 8 << 20

def might_hold(text: Column) -> Column:
    """False only for texts without entities: what every entity of a kind has in it, told at far less cost than by PATTERN."""
    has = text.contains
    need = [
        has("@"), text.rlike("[0-9+][0-9.:-]"), has("Bearer "), has("-----BEGIN "), has("AKIA"), has("ASIA"), has("_live_"), has("_test_"),
        (has("=") | has(":")) & text.rlike(rf"(?=[AaPpSsTt]){_ASSIGNED}"), text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]"),
        text.rlike("gh[pousr]_|xox[abeprs]-"), text.rlike("[0-9a-f]{32}"), text.rlike(rf"(?=[DFHMPSгдп])(?:{_ADDRESS})\.? \p{{Lu}}"),
    ]
    return functools.reduce(Column.__or__, need)


LETTERS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "hex": "0123456789abcdef"}
#: Names are spelled from these: open syllables, then an end that shows the gender.
LETTERS |= {"cyr": "абвгдежзиклмнопрстуфхцчшэюя", "CYR": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"}
LATIN, CYRILLIC = ("b d f g k l m n p r s t v z", "a e i o u"), ("б д ж з к л м н п р с т в х", "а е и о у")
ENDS = {("latin", "f"): "a ia ella ine", ("latin", "m"): "o an ert us", ("latin", "n"): "is el in y", ("latin", "s"): "er son ski mann", ("cyrillic", "f"): "а ия ина ела", ("cyrillic", "m"): "ан ир ей ор", ("cyrillic", "n"): "и ель инь ей", ("cyrillic", "sf"): "ова ева ина ская", ("cyrillic", "sm"): "ов ев ин ский"}


def _draw(seed: Column, i: Column, n: int) -> Column:
    """The i-th number below n of a keyed seed."""
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _spell(text: Column, seed: Column, lower: str = "lower") -> Column:
    """text with every digit and letter replaced by another of its class (letters of other alphabets by Latin ones, Cyrillic by Cyrillic); the rest stays."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda kind: F.substring(F.lit(LETTERS[kind]), _draw(seed, i, len(LETTERS[kind])) + 1, F.lit(1))
        if lower == "hex":
            return pick("hex")
        return F.when(c.between("0", "9"), pick("digit")).when(c.between("A", "Z"), pick("upper")).when(c.between("a", "z"), pick("lower")).when(F.ascii(c) < 128, c).when(c.rlike(r"\p{IsCyrillic}"), F.when(F.lower(c) != c, pick("CYR")).otherwise(pick("cyr"))).when(c.rlike(r"\p{Lu}"), pick("upper")).when(c.rlike(r"\p{L}"), pick("lower")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _syllables(seed: Column, k: Column, script: tuple[str, str], ends: str) -> Column:
    """A name of two open syllables and an end; of more syllables in later draws, for corpora of many names."""
    sounds = F.array(*[F.lit(c + v) for c in script[0].split() for v in script[1].split()])
    parts = [F.get(sounds, _draw(seed, F.lit(i), len(script[0].split()) * len(script[1].split()))) for i in range(4)]
    parts[2:] = [F.when(k >= 4 * (i + 1), p).otherwise("") for i, p in enumerate(parts[2:])]
    last = F.get(F.array(*[F.lit(e) for e in ends.split()]), _draw(seed, F.lit(4), len(ends.split())))
    return F.initcap(F.concat(*parts, F.regexp_replace(last, "^[aeiouаеиоу](?=.)", "")))


#: Kinds of name parts: script and end.
PARTS = {f"given-{script}-{g}": (sounds, ENDS[(script, g)]) for script, sounds in (("latin", LATIN), ("cyrillic", CYRILLIC)) for g in "fmn"}
PARTS |= {"family-latin": (LATIN, ENDS[("latin", "s")]), "family-cyrillic-f": (CYRILLIC, ENDS[("cyrillic", "sf")]), "family-cyrillic-m": (CYRILLIC, ENDS[("cyrillic", "sm")])}


def luhn(digits: Column) -> Column:
    """Sum of digits (an array of int) with every second from the right, but one, doubled: 0 modulo 10 where the last is a check digit."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, d: a + d)


def digits_of(e: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(e, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def canonical(kind: Column, e: Column) -> Column:
    """The canonical entities (kind, c) that a mention e names; one, or two where a name has two parts."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    abroad = e.startswith("+") & ~digits.rlike("^1[0-9]{10}$")
    cc = F.regexp_extract(digits, f"^({COUNTRY})", 1)
    phone = F.when(abroad, F.concat(cc, F.lit(":"), F.substring(digits, F.length(cc) + 1, F.length(digits)))).otherwise(F.regexp_replace(digits, "^1(?=[0-9]{10}$)", ""))
    rest = F.regexp_replace(e, rf"^(?:{_ADDRESS})\.? ", "")
    script = F.when(rest.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    title = F.regexp_extract(e, rf"^({_ADDRESS})", 1)
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*NEUTRAL), "n").otherwise("m")
    own = F.when(gender != "n", gender).when(rest.rlike("[ая]$"), "f").otherwise("m")
    part = lambda kind, c: F.struct(kind.alias("kind"), F.initcap(c).alias("c"))
    family = part(F.when(script == "latin", "family-latin").otherwise(F.concat(F.lit("family-cyrillic-"), own)), F.substring_index(rest, " ", -1))
    name = F.when(rest.contains(" "), F.array(part(F.concat(F.lit("given-"), script, F.lit("-"), gender), F.substring_index(rest, " ", 1)), family)).otherwise(F.array(family))
    c = (
        F.when(kind == "card", digits).when(kind == "phone", phone).when(kind.isin("email", "ipv6"), F.lower(e))
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind == "secret", F.regexp_replace(e, SECRET_HEAD, "")).when(kind == "bearer", F.substring(e, 8, 1 << 30)).otherwise(e)
    )
    return F.when(kind == "name", name).otherwise(F.array(F.struct(F.when(kind.isin("akia", "hex", "bearer", "service"), "secret").otherwise(kind).alias("kind"), c.alias("c"))))


def _poured(e: Column, chars: Column, fits: str) -> Column:
    """e with its characters of the class replaced by the last of chars, in order; ahead of them it stays."""
    cells = F.split(e, "")
    ahead = F.size(F.filter(cells, lambda x: x.rlike(fits))) - F.length(chars)
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))

    def step(a: Column, x: Column) -> Column:
        at = a["n"] - ahead
        new = F.when(~x.rlike(fits) | (at < 1), x).otherwise(F.substring(chars, at, F.lit(1)))
        return F.struct(F.concat(a["out"], new).alias("out"), (a["n"] + x.rlike(fits).cast("int")).alias("n"))

    return F.aggregate(cells, state, step)["out"]


def spelled(kind: Column, e: Column, s: Column) -> Column:
    """The surrogates s (an array) of what e names, in the format of e."""
    one = F.get(s, F.lit(0))
    cases = F.array_join(F.zip_with(F.split(one, ""), F.split(e, ""), lambda a, b: F.when((F.lower(b) != b), F.upper(a)).otherwise(F.coalesce(a, F.lit("")))), "")
    form = F.regexp_extract(e, rf"^((?:{_ADDRESS})\.? )", 1)
    rest = F.regexp_replace(e, rf"^(?:{_ADDRESS})\.? ", "")
    name = F.array_join(F.zip_with(F.split(rest, " "), s, lambda w, x: F.when((F.upper(w) == w) & (F.length(w) > 2), F.upper(x)).otherwise(x)), " ")
    return (
        F.when(kind == "card", _poured(e, one, "[0-9]")).when(kind == "phone", _poured(e, F.regexp_replace(one, "^[0-9]+:", ""), "[0-9]"))
        .when(kind == "iban", _poured(e, one, "[A-Z0-9]")).when(kind.isin("email", "ipv6"), cases).when(kind == "bearer", F.concat(F.lit("Bearer "), one))
        .when(kind == "secret", F.concat(F.regexp_extract(e, SECRET_HEAD, 1), one)).when(kind == "name", F.concat(form, name)).otherwise(one)
    )


def _card(e: Column, seed: Column) -> Column:
    body = F.expr("substring(concat(substring(e, 1, 1), substring(s, 2)), 1, length(e) - 1)")
    return F.concat(body, F.pmod(10 - F.pmod(luhn(digits_of(F.concat(body, F.lit("0")))), F.lit(10)), F.lit(10)).cast("string"))


def _iban(e: Column, account: Column) -> Column:
    """Country of e, check digits (mod 97 of account, country and 00) and account."""
    country = F.substring(e, 1, 2)

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))

    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def kind_of(e: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(KINDS.items())[:-1]):
        # what follows a secret belongs to its pattern, but is not here
        out = F.when(e.rlike(SECRET_HEAD if kind == "secret" else f"^(?:{pattern})$"), F.lit("card" if kind == "run" else kind)).otherwise(out)
    # an unbroken run of digits that is no card stays
    run = e.rlike(f"^(?:{KINDS['run']})$") & ~e.rlike(f"^(?:{KINDS['card']})$")
    return F.when(run & (F.pmod(luhn(digits_of(e)), F.lit(10)) != 0), F.lit("none")).otherwise(out)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Canonical entities (kind, e, k) with s, the k-th draw of the surrogate of e under the key."""
    rows = entities.withColumn("seed", F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "e", F.col("k").cast("string")), 256))
    seed, e = F.col("seed"), F.col("e")
    rows = rows.withColumn("s", _spell(e, seed))
    host = F.substring_index("e", "@", -1)
    shared = F.substring_index(host, ".", -2).isin(*SHARED_HOSTS)
    last = F.when(shared, F.substring_index(host, ".", -2)).otherwise(F.concat(F.lit("."), F.substring_index(host, ".", -1)))
    inner = F.substring(host, F.lit(1), F.length(host) - F.length(last))
    host_seed = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("host"), host), 256)
    email = F.concat(_spell(F.substring_index(e, "@", 1), seed), F.lit("@"), F.when(inner != "", _spell(inner, host_seed)).otherwise(F.lit("")), last)
    octet = [(_draw(seed, F.lit(i), 254) + 1).cast("string") for i in range(4)]
    # private, loopback and link-local addresses stay so; public ones get a first octet of the public range 11 to 126
    ip = F.when(e.rlike(r"^(?:10|127)\."), F.concat_ws(".", F.substring_index(e, ".", 1), *octet[1:]))
    ip = ip.when(e.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), (_draw(seed, F.lit(1), 16) + 16).cast("string"), *octet[2:]))
    ip = ip.when(e.rlike(r"^(?:192\.168|169\.254)\."), F.concat_ws(".", F.substring_index(e, ".", 2), *octet[2:]))
    ip = ip.otherwise(F.concat_ws(".", (_draw(seed, F.lit(0), 116) + 11).cast("string"), *octet[1:]))
    code = F.regexp_extract(e, "^([0-9]+:)", 1)
    own = _spell(F.regexp_replace(e, "^[0-9]+:", ""), seed)
    phone = F.concat(code, F.when(F.length(e) == 10, F.regexp_replace(own, "^([0-9]{3})[01]", "$17")).otherwise(own))
    phone = F.regexp_replace(phone, "(^|:)[01]", "$17")
    secret = F.when(e.rlike(HEADS["service"]), F.concat(F.regexp_extract(e, HEADS["service"], 1), _spell(F.regexp_replace(e, HEADS["service"], ""), seed)))
    secret = secret.when(e.rlike("^[0-9a-f]+$"), _spell(e, seed, "hex")).when(e.rlike(f"^(?:{KINDS['akia']})$"), F.concat(F.substring(e, 1, 4), F.expr("substring(s, 5)"))).otherwise(_spell(e, seed))
    head, tail = F.regexp_extract(e, HEADS["pem"], 1), F.regexp_extract(e, "(-----END [A-Z ]{1,40}-----)$", 1)
    pem = F.concat(head, _spell(F.substring(e, F.length(head) + 1, F.length(e) - F.length(head) - F.length(tail)), seed), tail)
    ipv6 = F.array_join(F.transform(F.split(e, ":"), lambda g, i: F.when(g == "", g).otherwise(_spell(g, F.concat(seed, i.cast("string")), "hex"))), ":")
    name = F.lit(None).cast("string")
    for part, (script, ends) in PARTS.items():
        name = F.when(F.col("kind") == part, _syllables(seed, F.col("k"), script, ends)).otherwise(name)
    return rows.withColumn(
        "s",
        F.when(F.col("kind") == "email", email).when(F.col("kind") == "ipv4", ip).when(F.col("kind") == "phone", phone)
        .when(F.col("kind") == "card", _card(e, seed)).when(F.col("kind") == "ssn", F.regexp_replace("s", "^[069]", "4"))
        .when(F.col("kind") == "iban", _iban(e, F.expr("substring(s, 5)"))).when(F.col("kind") == "pem", pem).when(F.col("kind") == "ipv6", ipv6)
        .when(F.col("kind") == "secret", secret).when(F.col("kind").isin(*PARTS), name)
        .otherwise(F.col("s")),
    ).drop("seed")


def assign(entities: DataFrame, key: str, tries: int = TRIES) -> DataFrame:
    """(e, kind, s): one surrogate for each distinct entity (kind, e); no two share one and none is an entity.

    Each round draws for what is left; of those that draw the same the smallest entity keeps it. After
    tries rounds the rest, of formats with hardly a free value, get a digest at the end of the last draw.
    """
    paths: list[str] = []
    real = entities.select(F.col("e").alias("s"))
    pending, taken = entities.withColumn("k", F.lit(0)), None
    for k in range(tries):
        drawn = cut(surrogates(pending.withColumn("k", F.lit(k)), key), "pii-draws", paths)
        first = drawn.groupBy("s").agg(F.min(F.struct("e", "kind")).alias("m")).select("s", "m.e", "m.kind")
        good = first.join(real, "s", "left_anti")
        if taken is not None:
            good = good.join(taken.select("s"), "s", "left_anti")
        won = drawn.join(good, ["s", "e", "kind"], "left_semi").select("e", "kind", "s")
        taken = cut(won if taken is None else taken.unionByName(won), "pii-taken", paths)
        pending = cut(drawn.join(taken.select("e", "kind"), ["e", "kind"], "left_anti").select("kind", "e", "k"), "pii-left", paths)
        if pending.isEmpty():
            break
    else:
        last = surrogates(pending, key).select("e", "kind", F.concat("s", F.lit("-"), F.substring(F.sha2(F.concat(F.lit(key), "kind", "e"), 256), 1, 16)).alias("s"))
        taken = taken.unionByName(last)
    out = cut(taken, "pii-map")
    drop_paths(entities.sparkSession, paths)
    return out


def _bare_names(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(h1, h2, __bare): of each text (h1, h2, t) the known full names (pair in lower case, names) that it holds, as written, with their surrogates."""
    runs = texts.dropDuplicates(["h1", "h2"]).select("h1", "h2", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(CAPITALS), F.lit(0)))).alias("r"))
    w = F.split("r", " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    pairs = runs.select("h1", "h2", F.explode(pairs).alias("old")).distinct().withColumn("pair", F.lower("old"))
    new = F.array_join(F.zip_with(F.split("old", " "), "names", lambda a, x: F.when((F.upper(a) == a) & (F.length(a) > 2), F.upper(x)).otherwise(x)), " ")
    return pairs.join(known, "pair").groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("old", new.alias("new")))).alias("__bare"))


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with every entity in the text column replaced; count, if given, names a column of how many.

    All rows and columns stay, in the order of docs (a column named like count is replaced). Null and
    empty texts stay. Equal texts are worked out once; every mention in a long text is replaced.
    """
    spark = docs.sparkSession
    paths: list[str] = []
    columns = [c for c in docs.columns if c != count or c == text]
    t = F.col(f"`{text}`")
    h = [F.xxhash64(t), F.xxhash64(F.lit("second"), t)]
    found = docs.where(t.isNotNull() & might_hold(t)).select(h[0].alias("h1"), h[1].alias("h2"), F.posexplode(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).alias("pos", "e"))
    found = cut(found.dropDuplicates(["h1", "h2", "pos"]), "pii-found", paths)
    entities = cut(found.groupBy("e").agg(F.lit(1).alias("x")).select(kind_of(F.col("e")).alias("kind"), "e"), "pii-entities", paths)
    parts = cut(entities.where("kind != 'none'").select("kind", "e", F.posexplode(canonical(F.col("kind"), F.col("e"))).alias("part", "of")), "pii-parts", paths)
    drawn = assign(parts.select("of.kind", F.col("of.c").alias("e")).distinct(), key)
    paths.append(drawn.inputFiles()[0].rsplit("/", 1)[0]) if drawn.inputFiles() else None
    mapping = parts.join(drawn.select(F.struct("kind", F.col("e").alias("c")).alias("of"), "s"), "of")
    mapping = mapping.groupBy("kind", "e").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]).alias("s"))
    rest = F.regexp_replace("e", rf"^(?:{_ADDRESS})\.? ", "")
    known = mapping.where("kind = 'name' and size(s) = 2").groupBy(F.lower(rest).alias("pair")).agg(F.min("s").alias("names"))
    known = cut(known, "pii-known", paths)
    mapping = mapping.select("e", spelled(F.col("kind"), F.col("e"), F.col("s")).alias("s"), F.lit(1).alias("real"))
    mapping = cut(mapping.unionByName(entities.where("kind = 'none'").select("e", F.col("e").alias("s"), F.lit(0).alias("real"))), "pii-spelled", paths)
    lists = found.join(mapping, "e").groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("l"), F.sum("real").alias("n"))
    lists = lists.select("h1", "h2", F.transform("l", lambda x: x["s"]).alias("__list"), F.col("n").alias("__n"))
    bare = F.array().cast("array<struct<old:string,new:string>>")
    if known.isEmpty():
        lists = lists.withColumn("__bare", bare)
    else:
        lists = lists.join(_bare_names(docs.where(t.isNotNull()).select(h[0].alias("h1"), h[1].alias("h2"), t.alias("t")), known), ["h1", "h2"], "full")
        lists = lists.withColumns({"__n": F.coalesce("__n", F.lit(0)), "__bare": F.coalesce("__bare", bare)})
    lists = cut(lists, "pii-lists")
    size = lists.agg(F.coalesce(F.sum(F.expr("octet_length(concat_ws('', __list)) + 32 * coalesce(size(__list), 0) + 128 * size(__bare) + 64")), F.lit(0)).alias("b")).first().b
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), h[0].alias("h1"), h[1].alias("h2"))
    rows = rows.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, ["h1", "h2"], "left")
    body = F.col("row").getField(text)
    gaps = F.split(body, PATTERN, -1)
    filled = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.col("__list"), F.array(F.lit(""))), lambda g, s: F.array(g, s))), "")
    filled = F.when(F.col("__list").isNull(), body).otherwise(filled)
    alone = lambda x: F.concat(F.lit(r"(?<!\p{L})\Q"), x["old"], F.lit(r"\E(?!\p{L})"))
    more = F.aggregate("__bare", F.lit(0), lambda n, x: n + F.size(F.regexp_extract_all(filled, alone(x), F.lit(0))))
    new = F.when(F.coalesce(F.size("__bare"), F.lit(0)) == 0, filled).otherwise(F.aggregate("__bare", filled, lambda s, x: F.regexp_replace(s, alone(x), x["new"])))
    many = F.coalesce("__n", F.lit(0)) + F.when(F.size("__bare") > 0, more).otherwise(0)
    drop_paths(spark, paths)
    done = rows.select("row", F.struct(new.alias("text"), many.cast("int").alias("n")).alias("new"))
    out = [F.col("new.text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns]
    return done.select(*out, *([F.col("new.n").alias(count)] if count else []))
