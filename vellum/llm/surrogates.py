"""Surrogates for personal data (native).

E-mail addresses, phone, card and social-security numbers, IBANs, IP addresses and names (after a title, or of a
known given name and a capitalised word) are found by one pattern; a text's pieces between them never change. Every distinct entity gets one replacement, drawn
from sha256(key, kind, canonical form, attempt), so that the same entity reads the same in every document
(coreference; a surname alone and with a given name share their surname's replacement):

* numbers keep their punctuation, a phone its country code, a card its first digit, an IBAN its country, and both whether their
  check digits are right;
* addresses keep the shape of their parts and the top-level domain, and a domain's replacement is shared;
* IPv4 addresses stay in their private range or go to the reserved 240/4, IPv6 addresses go to the documentation range 2001:db8;
* names keep title, gender (of the title, else of the given name; where neither tells, any name is drawn), script and number of parts.

Surnames and domains are entities of their own, drawn first. Replacements are compared with each other and
with every entity found; those that meet are drawn again until none does, so distinct entities stay distinct and
no replacement is somebody else's real datum. The space widens with the attempt, so that the draws always end:
surnames and given names get more syllables, local parts and domains more letters, numbers more digits at their
end, and private IPv4 addresses go from their range to 10/8, then to 240/4, and last anywhere.

Defined results: null text stays null; texts without entities pass unchanged; documents repeated with one
doc_id are each rewritten; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import attach, cut, table

KEY = "surrogate-key-1"
#: Titles of men and of women, and given names to choose from, by script.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин", "Г-н", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа", "Г-жа", "Κυρία"],
}
#: Titles of either, and given names by which an untitled name is known.
TITLES["n"] = ["Dr", "Prof", "Professor", "Doctor", "Доктор"]
KNOWN = {
    "m": [
        "Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Brian", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "François", "Friedrich",
        "George", "Hans", "Heinrich", "Henri", "Henry", "Jacques", "James", "Javier", "John", "José", "Joseph", "Juan", "Jürgen", "Kevin", "Klaus", "Louis", "Luis", "Manuel",
        "Matthew", "Michael", "Michel", "Miguel", "Nicolas", "Pablo", "Patrick", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Stefan", "Stephen",
        "Steven", "Thomas", "Timothy", "Wilhelm", "William", "Wolfgang",
    ],
    "f": [
        "Alice", "Amélie", "Andrea", "Angela", "Anna", "Barbara", "Camille", "Carmen", "Catherine", "Claire", "Deborah", "Elena", "Elizabeth", "Emily", "Emma", "Françoise",
        "Hannah", "Isabel", "Jane", "Jennifer", "Jessica", "Johanna", "Karen", "Katharina", "Laura", "Linda", "Lisa", "Lucía", "Margaret", "Maria", "María", "Marie", "Mary",
        "Michelle", "Monika", "Nancy", "Patricia", "Petra", "Rebecca", "Sabine", "Sarah", "Sophie", "Susan", "Susanne", "Ursula",
    ],
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "Denis", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karim", "Leo", "Marco", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla", "Lena", "Martha", "Nora", "Olga", "Paula"],
    ("cyrillic", "m"): ["Борис", "Виктор", "Глеб", "Денис", "Игорь", "Кирилл", "Лев", "Павел"],
    ("cyrillic", "f"): ["Алла", "Вера", "Дарья", "Елена", "Инна", "Лидия", "Нина", "Ольга"],
    ("greek", "m"): ["Ανδρέας", "Γιώργος", "Κώστας", "Νίκος", "Πέτρος", "Στέλιος", "Τάσος", "Φώτης"],
    ("greek", "f"): ["Άννα", "Βάσω", "Δανάη", "Ελένη", "Ζωή", "Ιωάννα", "Κλειώ", "Μαρία"],
}
SYLLABLES = {
    "latin": ["bar", "den", "fol", "gar", "hol", "kem", "lan", "mor", "nes", "par", "ros", "sel", "tan", "vor", "wes", "zim"],
    "cyrillic": ["бар", "вол", "гор", "дан", "жил", "кол", "лом", "мор", "нар", "пол", "рос", "сел", "тар", "фед", "хол", "шум"],
    "greek": ["βαρ", "γαλ", "δελ", "θεο", "καλ", "λαμ", "μαρ", "νικ", "παλ", "ραφ", "σαρ", "ταν", "φιλ", "χαρ", "ψαλ", "ζερ"],
}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _by_letter(words: list[str]) -> str:
    """An alternation that looks at a word's first letter once: most places of a text are left at it."""
    ends: dict[str, list[str]] = {}
    for w in words:
        ends.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in ends.items())


EVERY_TITLE = _by_letter([t for ts in TITLES.values() for t in ts])
EVERY_KNOWN = _by_letter([g for gs in KNOWN.values() for g in gs])
CAPITAL = r"(?=[A-ZÀ-ÞΑ-ΩА-Я])"
PART = r"\p{Lu}[\p{L}’'-]{1,40}"
HEX = r"[0-9A-Fa-f]{1,4}"
#: Calling codes of one and two digits; all others have three.
CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "name": rf"{CAPITAL}(?<![\p{{L}}\p{{N}}])(?:(?:{EVERY_TITLE})\.? {PART}(?: {PART})?|(?:{EVERY_KNOWN}) {PART})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}:(?:{HEX}(?::{HEX}){{0,5}}+)?+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+(?=(?:[0-9][ .-]?){7,14}[0-9](?![0-9]))[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){2,6}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds: a cheap test before the patterns.
HINT = rf"[0-9@]|{CAPITAL}(?:(?:{EVERY_TITLE}|{EVERY_KNOWN})\.? \p{{Lu}})"
TITLED = rf"^(?:{EVERY_TITLE})\.? "


def kind_of(value: Column) -> Column:
    out = F.lit("phone")
    for kind in reversed([k for k in PATTERNS if k != "phone"]):
        out = F.when(value.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def canonical(kind: Column, value: Column) -> Column:
    """What makes two mentions one entity."""
    name = F.lower(F.regexp_replace(value, TITLED, ""))
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "ipv4", value)
        .when(kind == "ipv6", F.lower(value))
        .when(kind == "name", F.concat(_gender(value), F.lit(":"), name))
        .when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits_of(value)))
        .otherwise(digits_of(value))
    )


def _gender(value: Column) -> Column:
    """f or m by the title, else by a known given name before another word, else n."""
    out = F.lit("n")
    for g in ("m", "f"):
        names = "|".join([*KNOWN[g], *GIVEN["latin", g], *GIVEN["cyrillic", g], *GIVEN["greek", g]])
        out = F.when(value.rlike(rf"^(?:(?:{EVERY_TITLE})\.? )?(?:{names}) "), g).otherwise(out)
    for g in ("m", "f"):
        out = F.when(value.rlike("^(?:" + "|".join(TITLES[g]) + r")\.? "), g).otherwise(out)
    return out


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def drawn(kind: Column, what: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits for a thing."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, what, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f2")), 256))


def reshaped(value: Column, draw: Column) -> Column:
    """value with every letter and digit replaced in place by one of its kind; the rest stays."""
    hexes = "0123456789abcdef"
    low, up, num = (F.translate(draw, hexes, to) for to in ("bcdfghjklmnprstv", "BCDFGHJKLMNPRSTV", "0123456789412753"))

    def one(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(128)) + 1
        return (
            F.when(c.rlike("[0-9]"), F.substring(num, at, F.lit(1)))
            .when(c.rlike(r"\p{Lu}"), F.substring(up, at, F.lit(1)))
            .when(c.rlike(r"\p{L}"), F.substring(low, at, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn(digits: Column) -> Column:
    """Sum of the check-digit rule; right numbers are multiples of ten."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def iban_rest(text: Column) -> Column:
    """text as a number (A = 10 to Z = 35) modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: (
        F.when(c.rlike("^[0-9]$"), (a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).when(c.rlike("^[A-Z]$"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a)
    ))


def byte(draw: Column, i: int) -> Column:
    return F.conv(F.substring(draw, 1 + 2 * i, 2), 16, 10).cast("int")


def choose(items: list[str], draw: Column, i: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), byte(draw, i) % len(items) + 1)


def syllables(script: Column, draw: Column, count: Column) -> Column:
    def one(k: Column, items: list[str]) -> Column:
        at = F.conv(F.substring(draw, F.pmod(k + 8, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.element_at(F.array(*[F.lit(x) for x in items]), at % len(items) + 1)

    out = None
    for name, items in SYLLABLES.items():
        made = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: one(k, items)), "")
        out = made if out is None else F.when(script == name, made).otherwise(out)
    return F.when(count > 0, out).otherwise("")


def given(gender: Column, script: Column, draw: Column) -> Column:
    out = F.lit("Alex")
    for (s, g), items in [*GIVEN.items(), *(((s, "n"), GIVEN[s, "m"] + GIVEN[s, "f"]) for s in SYLLABLES)]:
        out = F.when((gender == g) & (script == s), choose(items, draw, 3)).otherwise(out)
    return out


def part_of(kind: Column, what: Column) -> Column:
    """The entity that others share: an address's domain, a name's surname; null for other kinds."""
    domain = F.concat_ws("\x1f", F.lit("domain"), F.substring_index(what, "@", -1))
    return F.when(kind == "email", domain).when(kind == "name", F.concat_ws("\x1f", F.lit("surname"), F.substring_index(F.substring(what, 3, 200), " ", -1)))


def surrogate(kind: Column, what: Column, part: Column, attempt: Column, key: str) -> Column:
    """The canonical replacement of a canonical entity; part is that of its part_of."""
    draw = drawn(kind, what, attempt, key)
    more = F.floor(attempt / 2).cast("int")
    letters = F.substring(F.translate(draw, "0123456789abcdef", "bcdfghjklmnprstv"), F.lit(90), more)
    email = F.concat(F.lower(reshaped(F.substring_index(what, "@", 1), draw)), letters, F.lit("@"), part)
    top = F.substring_index(what, ".", -1)
    below = F.substring(what, F.lit(1), F.length(what) - F.length(top) - 1)
    domain = F.concat(F.lower(reshaped(below, draw)), letters, F.lit("."), top)
    first = F.substring_index(what, ".", 1)
    rest = [F.pmod(byte(draw, i), F.lit(256)).cast("string") for i in range(4)]
    reserved = F.concat_ws(".", (byte(draw, 0) % 15 + 240).cast("string"), *rest[1:])
    private = what.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    ipv4 = (
        F.when(attempt >= 24, F.concat_ws(".", *rest))
        .when(private & (attempt >= 12), reserved)
        .when(private & (attempt >= 6), F.concat_ws(".", F.lit("10"), *rest[1:]))
        .when(first == "10", F.concat_ws(".", F.lit("10"), *rest[1:]))
        .when(what.rlike(r"^192\.168\."), F.concat_ws(".", F.lit("192.168"), *rest[2:]))
        .when(what.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), (byte(draw, 1) % 16 + 16).cast("string"), *rest[2:]))
        .when(first == "127", F.concat_ws(".", F.lit("127"), *rest[1:]))
        .otherwise(reserved)
    )
    digits = F.substring(F.translate(draw, "0123456789abcdef", "0123456789412753"), F.lit(90), F.floor(attempt / 4).cast("int"))
    plain = F.concat(reshaped(what, draw), digits)
    card = F.concat(F.substring(what, 1, 1), F.substring(plain, 2, 64))
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    fixed = F.concat(body, F.pmod(10 - F.pmod(luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    wrong = F.concat(body, F.pmod(F.lit(11) - F.pmod(luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    code = F.regexp_extract(what, CODE, 0)
    phone = F.concat(code, F.substring(plain, F.length(code) + 1, F.lit(64)))
    account, country = F.substring(plain, 5, 64), F.substring(what, 1, 2)
    sound = iban_rest(F.concat(F.substring(what, 5, 64), F.substring(what, 1, 4))) == 1
    check = 98 - iban_rest(F.concat(account, country, F.lit("00")))
    iban = F.concat(country, F.lpad(F.when(sound, check).otherwise(F.pmod(check, F.lit(97)) + 1).cast("string"), 2, "0"), account)
    groups = [F.regexp_replace(F.substring(draw, 1 + 4 * i, 4), "^0+(?=.)", "") for i in range(6)]
    ipv6 = F.concat_ws(":", F.lit("2001:db8"), *groups)
    gender, name = F.substring(what, 1, 1), F.substring(what, 3, 200)
    own = F.concat(given(gender, script_of(name), draw), syllables(script_of(name), draw, more))
    person = F.when(F.instr(name, " ") > 0, F.concat(own, F.lit(" "), part)).otherwise(part)
    return (
        F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "surname", syllables(script_of(what), draw, attempt + 4)).when(kind == "ipv4", ipv4).when(kind == "card", F.when(luhn(what) % 10 == 0, fixed).otherwise(wrong))
        .when(kind == "phone", phone).when(kind == "name", F.concat(gender, F.lit(":"), F.lower(person)))
        .when(kind == "iban", iban).when(kind == "ipv6", ipv6).otherwise(plain)
    )


def worded(kind: Column, value: Column, made: Column) -> Column:
    """A canonical replacement written as the mention was."""
    title = F.regexp_extract(value, TITLED, 0)

    def spaced(c: Column, i: Column) -> Column:  # digit for digit; signs between stay
        seen = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9A-Z]", ""))
        return F.when(c.rlike("[0-9A-Z]"), F.substring(F.regexp_replace(made, r"[^0-9A-Z]", ""), seen + 1, F.lit(1))).otherwise(c)

    laid = F.array_join(F.transform(F.split(value, ""), spaced), "")
    room = F.length(F.regexp_replace(value, "[^0-9A-Z]", ""))
    laid = F.concat(laid, F.substring(F.regexp_replace(made, "[^0-9A-Z]", ""), room + 1, F.lit(64)))
    return F.when(kind == "name", F.concat(title, F.initcap(F.substring(made, 3, 200)))).when(kind.isin("email", "ipv4", "ipv6"), made).otherwise(laid)


def draw_apart(entities: DataFrame, key: str) -> DataFrame:
    """kind, what, n and made of entities (kind, what, part, n): replacements that meet neither each other nor any entity."""
    now = entities.withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("what").alias("made"))
    while True:  # ends, because the space grows with the attempt
        drawing = surrogate(F.col("kind"), F.col("what"), F.col("part"), F.col("attempt"), key)
        made = cut(now.select("kind", "what", "part", "n", "attempt", drawing.alias("made")), "surrogates")
        one = Window.partitionBy("kind", "made").orderBy("attempt", "what")
        taken = made.join(real.withColumn("taken", F.lit(True)), ["kind", "made"], "left")
        marked = cut(taken.withColumn("again", (F.row_number().over(one) > 1) | F.coalesce("taken", F.lit(False))), "surrogates")
        if not marked.where("again").limit(1).count():
            return made.select("kind", "what", "n", "made")
        now = marked.select("kind", "what", "part", "n", F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))


def draw_all(entities: DataFrame, key: str) -> DataFrame:
    """kind, what, n and made: shared parts are drawn first, then all entities with them."""
    named = entities.withColumn("shared", part_of(F.col("kind"), F.col("what")))
    shared = named.where("shared IS NOT NULL")
    parts = cut(shared.groupBy("shared").agg(F.count(F.lit(1)).alias("n")), "surrogate-parts")
    split = parts.select(F.substring_index("shared", "\x1f", 1).alias("kind"), F.substring_index("shared", "\x1f", -1).alias("what"), F.lit(None).cast("string").alias("part"), "n")
    drawn_parts = draw_apart(split, key).select(F.concat_ws("\x1f", "kind", "what").alias("shared"), F.col("made").alias("part"), F.col("n").alias("size"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = attach(shared, drawn_parts, "shared", "size", total).select("kind", "what", "part", "n")
    alone = named.where("shared IS NULL").select("kind", "what", F.lit(None).cast("string").alias("part"), "n")
    return draw_apart(cut(whole.unionByName(alone), "surrogate-entities"), key)


def replace_entities(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """docs with text rewritten and n_entities (in place of a column of that name); only texts with entities are shuffled."""
    kept = [c for c in docs.columns if c not in (text_col, "n_entities")]
    text = F.col("_text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    has = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    shown = ["_doc.*", F.col("_text").alias(text_col), F.col("_n").alias("n_entities")]
    untouched = rows.where(~has).withColumn("_n", F.lit(0).cast("long"))
    hit = rows.where(has).withColumns({
        "_row": F.monotonically_increasing_id(),
        "_found": F.regexp_extract_all(text, F.lit(ANY), F.lit(0)),
        "_pieces": F.split(text, ANY, -1),
    })
    hit = cut(hit, "surrogate-texts")
    found = hit.select("_row", F.posexplode("_found").alias("_at", "value"))
    found = found.withColumn("kind", kind_of(F.col("value"))).withColumn("what", canonical(F.col("kind"), F.col("value")))
    found = cut(found.withColumn("entity", F.concat_ws("\x1f", "kind", "what")), "surrogate-mentions")
    n = found.count()
    entities = cut(found.groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n")), "surrogate-entities")
    made = draw_all(entities, key).select(F.concat_ws("\x1f", "kind", "what").alias("entity"), "made", "n")
    named = attach(found, cut(made, "surrogate-made"), "entity", "n", n).select(
        "_row", "_at", worded(F.col("kind"), F.col("value"), F.col("made")).alias("new")
    )
    lists = named.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "new"))), lambda s: s["new"]).alias("_new"))
    joined = hit.join(lists, "_row")
    mixed = F.transform("_pieces", lambda p, i: F.concat(p, F.coalesce(F.get("_new", i), F.lit(""))))
    done = joined.select("_doc", F.array_join(mixed, "").alias("_text"), F.size("_new").cast("long").alias("_n"))
    return untouched.unionByName(done).select(*shown)


def op9_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
