"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Each distinct entity gets a surrogate from an HMAC of its canonical form under the caller's
key, of the same type and format: digits for digits, letters of the same script and case, an
address for an address, a given name of the same gender. The same entity, in whatever form
it is written, gets the same surrogate everywhere. Surrogates that coincide with each other
or with an entity of the corpus are drawn anew, longer ones where a format is crowded, so
different entities stay different. They come from ranges that nobody holds (card numbers
from 0, IPv4 from 240/4, IPv6 from 2001:db8::/32, area codes from 0 and 1, the .example
domain, social security numbers from 9).

Names are found behind titles and introductions ("My name is ...", "signed: ..."), and beside an
address that is made of them. They are replaced word by word: "Mr. John Smith", "Mr Smith" and,
in a text that names him so, "John Smith" or "Smith" stay one person, and so does the address
john.smith@x.com. What a form tells of its origin stays: an IBAN's country, a phone number's
country code, a token's prefix, the words that make a street a street.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm.shared import cut

#: Where queries find the caller's key; without it they take a key that protects nobody.
KEY_SETTING, DEMONSTRATION_KEY = "spark.alertlake.pii.key", "demonstration only"

FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Signora|[Гг]оспожа|[Гг]-жа"
MALE = r"Mr|Herr|Monsieur|Señor|Signor|[Гг]осподин|[Гг]-н"
NEUTRAL = r"Dr|Prof|Professor"
TITLES = rf"{FEMALE}|{MALE}|{NEUTRAL}"
#: What a person's name follows.
INTRO = r"[Mm]y name is|[Nn]ame:|[Ss]igned(?: by|:)|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Мм]еня зовут"
EMAIL = r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++"
HEXTETS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})"
IPV6 = rf"(?<![:.])(?:{HEXTETS}{{7}}|(?:{HEXTETS}{{0,5}})?::(?:{HEXTETS}{{0,5}})?)(?![\p{{L}}\p{{N}}:])"
IP = r"(?<![.])(?:\d{1,3}+\.){3}+\d{1,3}+(?![\d]|\.\d)"
PHONE = r"(?<![(+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)|(?<!-)\d{3}-\d{3}-\d{4}(?![\d-])"
CARD = r"(?<!-)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\d-])"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])"
#: Countries by what follows their check digits in an IBAN; the length tells its end from a word in capitals behind it.
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK|FI|FO|GL|NL|FK|SD", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|XK|MN", 17: "CH|CR|HR|LI|LV", 18: "BG|BH|DE|GB|GE|IE|ME|RS|VA|SO",
    19: "AE|GI|IL|IQ|TL|OM", 20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG|LY", 21: "PT|ST|BI|DJ", 22: "IS|TR", 23: "FR|GR|IT|MC|MR|SM", 24: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV|NI",
    25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU|YE", 27: "MT|SC", 28: "LC", 29: "RU",
}
IBAN_KNOWN = "|".join(rf"(?<=(?:{of})\d\d)(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, of in IBAN_LENGTHS.items())
#: Other countries and lengths: 11 to 30 characters, the last group of 1 to 4.
IBAN_OTHER = r"(?:(?: ?[A-Z0-9]{4}){3,6}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){7}(?: ?[A-Z0-9]{1,2})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![A-Za-z0-9])"
IBAN = rf"[A-Z]{{2}}\d{{2}}(?:{IBAN_KNOWN}|{IBAN_OTHER})"
ACCESS_KEY = r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
#: Prefixes by which services mark their tokens.
TOKEN_PREFIX = r"gh[pousr]_|github_pat_|glpat-|sk-(?:proj-|ant-)?|[rs]k_(?:live|test)_|xox[abprs]-|AIza|eyJ"
TOKEN = rf"(?:{TOKEN_PREFIX})[A-Za-z0-9_-]{{16,255}}+(?:\.[A-Za-z0-9_-]{{4,2000}}+){{0,2}}"
HEX_SECRET = r"[0-9a-f]{40}(?![A-Za-z0-9])"
PASSWORD = r"(?<=(?i:password|passwd|passphrase|pwd)\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"'&;,]{4,128}+|(?<=(?i:api[_-]?key|secret|token)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/-]{16,128}+"
#: Words that tell a street by its side; they stay.
STREET_WORDS = r"Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square|rue|avenue|boulevard|place|allée|Calle|Avenida|Plaza|de|du|des|la|le|del"
CAPITAL = r"\p{Lu}[\p{L}'’-]{1,40}"
STREET = (
    rf"\d{{1,5}}[A-Za-z]? (?:{CAPITAL} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square)(?!\p{{L}})"
    rf"|\d{{1,4}},? (?:rue|avenue|boulevard|place|allée) (?:(?:de|du|des|la|le) ){{0,3}}{CAPITAL}|(?:Calle|Avenida|Plaza) (?:(?:de|del|la) ){{0,2}}{CAPITAL},? \d{{1,4}}(?!\d)"
    r"|\p{Lu}\p{Ll}{1,30}?(?:straße|strasse|gasse|allee|platz|weg) \d{1,4}[a-z]?(?![\p{L}\p{N}])"
)
NAME_WORD = rf"(?!(?:{TITLES})(?!\p{{L}})){CAPITAL}(?![\p{{L}}\p{{N}}])"
NAME = rf"(?:(?:{TITLES})\.? {NAME_WORD}(?: {NAME_WORD})?|(?:{INTRO}) {NAME_WORD}(?: {NAME_WORD}){{0,2}})"
MAC = r"(?<![:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"
#: Entities that are told by what stands before them, which stays.
PREFIXED = {
    "pem": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s{1,2}", r"[A-Za-z0-9+/=\s]{20,8000}(?=-----END)"),
    "bearer": (r"[Bb]earer ", r"[A-Za-z0-9._~+/-]{16,512}+=*"),
    "date": (r"(?:[Bb]orn(?: on)?|[Dd]ate of birth|DOB|[Gg]eboren am|[Nn]ée? le|[Nn]acid[oa] el):? ", r"(?:\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!\d)"),
    "document": (r"(?:[Pp]assport|[Aa]usweis|[Pp]asseport|[Pp]asaporte|ID card)(?:,? (?:[Nn]o|number|[Nn]r|n°|numéro|número|[Nn]ummer))?[.:]? (?:is )?", r"(?=[A-Z]{0,3}\d)[A-Z0-9]{6,12}(?![\p{L}\p{N}])"),
}
#: Country codes of phone numbers of one and two digits; all others have three.
COUNTRY_CODE = r"^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: No entity starts inside a word; a place that fails this test is tried with no pattern.
START = r"(?<![\p{L}\p{N}])"
ANY = f"{START}(?:" + "|".join((*(a + b for a, b in PREFIXED.values()), EMAIL, MAC, IPV6, IP, PHONE, CARD, SSN, IBAN, ACCESS_KEY, TOKEN, HEX_SECRET, PASSWORD, STREET, NAME)) + ")"
#: What every text with an entity has: a cheap test before the full pattern.
GATE = rf"[0-9@]|::|AKIA|[a-f]{{40}}|PRIVATE KEY|[Bb]earer |(?:[A-Fa-f]{{2}}[:-]){{5}}|(?:{INTRO}) |(?i:passw|passphrase|pwd|secret|token|api[_-]?key)|{TOKEN_PREFIX}|(?:{TITLES})\.? "
NAMES = ("female", "male", "name")
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуы", "greek": "αεηιου"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxz", "cyrillic": "бвгджзклмнпрстфхчш", "greek": "βγδζθκλμνξπρστφχ"}
#: From this round on surrogates get longer.
CROWDED = 6


def _type(m: str) -> str:
    of = {**{t: a + b.removesuffix("(?=-----END)") for t, (a, b) in PREFIXED.items()}, "mac": MAC, "email": EMAIL, "access_key": ACCESS_KEY, "token": TOKEN, "hex": HEX_SECRET, "ip": IP, "ipv6": IPV6, "card": CARD, "ssn": SSN, "phone": PHONE, "iban": IBAN, "street": STREET}
    return f"CASE WHEN {m} rlike '^{_q(NAME)}$' THEN 'name' " + " ".join(f"WHEN {m} rlike '^(?:{_q(p)})$' THEN '{t}'" for t, p in of.items()) + " ELSE 'password' END"


def _q(pattern: str) -> str:
    """A pattern inside a SQL string literal."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn_sum(digits: str) -> str:
    """The Luhn sum of a string of digits."""
    d = f"cast(substring({digits}, i, 1) AS int)"
    return f"aggregate(transform(sequence(1, length({digits})), i -> CASE WHEN (length({digits}) - i) % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END), 0, (a, b) -> a + b)"


def _canonical() -> str:
    """What the forms of one entity share; a name's words are entities of their own."""
    return f"""CASE type WHEN 'email' THEN lower(mention) WHEN 'phone' THEN right({_digits(f"regexp_replace(mention, '{_q(COUNTRY_CODE)}', '')")}, 10) WHEN 'mac' THEN lower(replace(mention, '-', ':'))
        {" ".join(f"WHEN '{t}' THEN regexp_replace(mention, '^(?:{_q(a)})', '')" for t, (a, _) in PREFIXED.items())}
        WHEN 'card' THEN {_digits("mention")} WHEN 'ssn' THEN {_digits("mention")} WHEN 'iban' THEN replace(mention, ' ', '')
        WHEN 'ipv6' THEN lower(mention) WHEN 'street' THEN lower(mention) ELSE mention END"""


def _genuine() -> str:
    """Whether a match is what it looks like."""
    octets = "forall(split(mention, '[.]'), o -> cast(o AS int) <= 255)"
    return f"""CASE type WHEN 'card' THEN {_luhn_sum(_digits('mention'))} % 10 = 0 WHEN 'ip' THEN {octets} WHEN 'phone' THEN length({_digits('mention')}) BETWEEN 8 AND 15
        WHEN 'ipv6' THEN mention rlike '[0-9]' AND length(mention) >= 6 ELSE true END"""


def _random(i: str) -> str:
    """A number from 0 to 255 for place i (from 1), from the column `stream` of hex digits."""
    return f"cast(conv(substring(stream, 2 * ({i}) - 1, 2), 16, 10) AS int)"


def _pick(letters: str, i: str) -> str:
    return f"substring('{letters}', 1 + {_random(i)} % {len(letters)}, 1)"


def _tail() -> str:
    """Letters that lengthen a surrogate of a fixed format in crowded rounds."""
    return f"array_join(transform(IF(round > {CROWDED}, sequence(1, least(20, 2 * (round - {CROWDED}))), array()), i -> {_pick(CONSONANTS['latin'], 'i + 100')}), '')"


def _like(text: str, digits: str = "0123456789", hexadecimal: bool = False) -> str:
    """Each letter and digit of `text` replaced by one of its kind, from `stream`."""
    c = f"substring({text}, i, 1)"
    cases = [f"WHEN {c} rlike '[0-9]' THEN {_pick('0123456789abcdef' if hexadecimal else digits, 'i')}"]
    if hexadecimal:
        cases.append(f"WHEN {c} rlike '[a-f]' THEN {_pick('0123456789abcdef', 'i')}")
    for script, of in (("latin", r"\\p{IsLatin}"), ("cyrillic", r"\\p{IsCyrillic}"), ("greek", r"\\p{IsGreek}")):
        vowel = {"latin": "aeiouàáâãäåæèéêëìíîïòóôõöøùúûü", "cyrillic": "аеёиоуыэюя", "greek": "αεηιουωάέήίόύώ"}[script]
        letter = f"IF(contains('{vowel}', lower({c})), {_pick(VOWELS[script], 'i')}, {_pick(CONSONANTS[script], 'i')})"
        cases.append(f"WHEN {c} rlike '{of}' THEN IF({c} = lower({c}), {letter}, upper({letter}))")
    cases.append(f"WHEN {c} rlike '\\\\p{{L}}' THEN {_pick(CONSONANTS['latin'], 'i')}")
    return f"array_join(transform(IF(length({text}) > 0, sequence(1, length({text})), array()), i -> CASE {' '.join(cases)} ELSE {c} END), '')"


def _surrogate() -> str:
    """The surrogate's canonical form, from canonical, hint, type, stream and round."""
    more = f"array_join(transform(IF(round > 1, sequence(1, least(24, 2 * round - 2)), array()), i -> {_pick(CONSONANTS['latin'], 'i + 40')}), '')"
    some = lambda n, first, letters="0123456789": "concat(" + ", ".join([first, *(_pick(letters, str(i)) for i in range(2, n + 1))]) + ")"
    local = f"coalesce(hint, {_like("substring_index(canonical, '@', 1)")})"
    domain = f"array_join(transform(filter(sequence(1, 8), i -> i <= greatest(1, size(split(substring_index(canonical, '@', -1), '[.]')) - 1)), i -> {_pick(CONSONANTS['latin'], 'i + 70')} || {_pick(VOWELS['latin'], 'i + 80')} || {_pick(CONSONANTS['latin'], 'i + 90')}), '.')"
    card = some(15, "'0'")
    hextet = lambda i: f"substring(sha2(concat(stream, '{i}'), 256), 1, 4)"
    gendered = lambda end: f"regexp_replace({_like('canonical')}, '^(\\\\p{{L}}+?)\\\\p{{L}}$', concat('$1', CASE WHEN canonical rlike '\\\\p{{IsCyrillic}}' THEN '{end[1]}' WHEN canonical rlike '\\\\p{{IsGreek}}' THEN '{end[2]}' ELSE '{end[0]}' END)) || {more}"
    prefix = f"regexp_extract(canonical, '^(?:{_q(TOKEN_PREFIX)})', 0)"
    # A street's own words stay, what lies between them is drawn.
    kept = _q(rf"(?i)(?<!\p{{L}})(?:{STREET_WORDS})(?!\p{{L}})|(?:straße|strasse|gasse|allee|platz|weg)(?= )")
    street = f"array_join(transform(split(canonical, '{kept}', -1), (part, k) -> concat({_like('part')}, coalesce(get(regexp_extract_all(canonical, '{kept}', 0), k), ''))), '')"
    part = f"IF(length(p) = 4, cast(1900 + {_random('k + 1')} % 100 AS string), lpad(cast(1 + {_random('k + 1')} % IF(length(p) = 1, 9, 12) AS string), length(p), '0'))"
    date = f"array_join(transform(split(canonical, '[./-]'), (p, k) -> {part}), regexp_extract(canonical, '[./-]', 0))"
    return f"""CASE type WHEN 'date' THEN concat({date}, {_tail()}) WHEN 'mac' THEN concat_ws(':', '02', {", ".join(f"substring(stream, {2 * i + 1}, 2)" for i in range(5))})
        WHEN 'email' THEN concat({local}, {more}, '@', {domain}, '.example')
        WHEN 'ip' THEN concat_ws('.', 240 + {_random('1')} % 16, {_random('2')}, {_random('3')}, {_random('4')}) || {_tail()}
        WHEN 'ipv6' THEN concat_ws(':', '2001:db8', {", ".join(hextet(i) for i in range(6))})
        WHEN 'phone' THEN concat(cast({_random('1')} % 2 AS string), substring({some(11, "''")}, 1, length(canonical) - 1), {_tail()})
        WHEN 'card' THEN concat({card}, (10 - {_luhn_sum(f"concat({card}, '0')")} % 10) % 10, {_tail()})
        WHEN 'ssn' THEN concat({some(9, "'9'")}, {_tail()})
        WHEN 'iban' THEN concat(substring(canonical, 1, 2), '00', {_like("substring(canonical, 5)")}, upper({_tail()}))
        WHEN 'access_key' THEN concat({some(17, "'AKIA'", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")}, upper({_tail()}))
        WHEN 'token' THEN concat({prefix}, {_like(f"substring(canonical, 1 + length({prefix}))")}, {_tail()})
        WHEN 'hex' THEN concat({_like('canonical', hexadecimal=True)}, {_tail()})
        WHEN 'street' THEN concat({street}, {_tail()})
        WHEN 'female' THEN {gendered('aаα')} WHEN 'male' THEN {gendered('nнσ')}
        ELSE concat({_like('canonical')}, {more}) END"""


def _cased(pattern: str, surrogate: str) -> str:
    """A surrogate in the case of what it stands for: all capitals, first letters, or as it is."""
    return f"CASE WHEN {pattern} = upper({pattern}) AND {pattern} <> lower({pattern}) THEN upper({surrogate}) WHEN {pattern} rlike '(?:^| )\\\\p{{Lu}}' THEN initcap({surrogate}) ELSE {surrogate} END"


def _written() -> str:
    """The surrogate in the form in which the entity was written."""
    drawn = "regexp_extract(surrogate, '^[0-9]+', 0)"
    n, k = f"length({_digits('mention')})", f"length({_digits('substring(mention, 1, i)')})"
    c = "substring(mention, i, 1)"
    filled = f"array_join(transform(sequence(1, length(mention)), i -> IF({c} rlike '[0-9]' AND {k} > {n} - length({drawn}), substring({drawn}, {k} - {n} + length({drawn}), 1), {c})), '')"
    spaced = "trim(regexp_replace(surrogate, '(.{4})', '$1 '))"
    return f"""CASE WHEN type IN ('phone', 'card', 'ssn') THEN concat({filled}, regexp_extract(surrogate, '[a-z]*$', 0))
        {" ".join(f"WHEN type = '{t}' THEN concat(regexp_extract(mention, '^(?:{_q(a)})', 0), surrogate)" for t, (a, _) in PREFIXED.items())}
        WHEN type = 'mac' THEN IF(mention = upper(mention), upper(IF(contains(mention, '-'), replace(surrogate, ':', '-'), surrogate)), IF(contains(mention, '-'), replace(surrogate, ':', '-'), surrogate))
        WHEN type = 'iban' THEN IF(contains(mention, ' '), {spaced}, surrogate)
        WHEN type = 'street' THEN array_join(transform(split(surrogate, ' '), (w, i) -> IF(get(split(mention, ' '), i) rlike '^\\\\p{{Lu}}', initcap(w), w)), ' ')
        WHEN type IN ('email', 'ipv6') AND mention = upper(mention) AND mention <> lower(mention) THEN upper(surrogate)
        ELSE surrogate END"""


def hmac(message: str, key: str | bytes) -> str:
    """HMAC-SHA-256 of a SQL string under a key, as hex digits."""
    raw = key.encode() if isinstance(key, str) else key
    block = (sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytes(x ^ pad for x in block).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode({message}, 'UTF-8')), 256))), 256)"


def surrogates(entities: DataFrame, key: str | bytes) -> DataFrame:
    """(type, canonical, hint) distinct -> (type, canonical, surrogate): one each, no two the same, none an entity itself.

    Types that look alike (given names of either gender, other names) share no surrogate
    either. hint: what an address begins with, or null.
    """
    space = F.when(F.col("type").isin(*NAMES), "name").otherwise(F.col("type")).alias("space")
    pending, done = cut(entities.select("type", "canonical", "hint"), "entities"), []
    real = pending.select(space, F.col("canonical").alias("surrogate")).distinct()
    for round_ in count(1):
        blocks = "transform(sequence(0, 4 + length(canonical) div 16), b -> " + hmac("concat_ws('|', round, b, type, canonical)", key) + ")"
        drawn = pending.withColumn("round", F.lit(round_)).withColumn("stream", F.expr(f"array_join({blocks}, '')"))
        drawn = drawn.select("type", space, "canonical", F.expr(_surrogate()).alias("surrogate"))
        # Of those that drew the same, one keeps it; a third of all rows can't draw alike, for entities are distinct here.
        first = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("canonical", "type")).alias("e"))
        first = first.join(real, ["space", "surrogate"], "left_anti")
        for earlier in done:
            first = first.join(earlier.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        done.append(cut(first.select("e.type", "e.canonical", "surrogate", "space"), "surrogates"))
        pending = cut(pending.join(done[-1], ["type", "canonical"], "left_anti"), "pending")
        if pending.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("space")


def names_of(mentions: DataFrame) -> DataFrame:
    """(mention, title, pos, word, type) of the words of names behind titles or introductions: a given name takes the title's gender, a last name only in scripts where it shows."""
    parts = mentions.select("mention", F.regexp_extract("mention", rf"^((?:{TITLES})\.? |(?:{INTRO}) )", 1).alias("title"))
    parts = parts.withColumn("words", F.split(F.expr("substring(mention, length(title) + 1)"), " "))
    gender = F.when(F.col("title").rlike(rf"^(?:{FEMALE})\b"), "female").when(F.col("title").rlike(rf"^(?:{MALE})\b"), "male").otherwise("name")
    each = parts.select("mention", "title", F.size("words").alias("n"), gender.alias("gender"), F.posexplode("words").alias("pos", "word"))
    given = ((F.col("pos") == 0) & (F.col("n") == 2)) | (F.col("word").rlike(r"\p{IsCyrillic}") & (F.col("gender") == "female"))
    return each.select("mention", "title", "n", "pos", "word", F.lower("word").alias("canonical"), F.when(given, F.col("gender")).otherwise("name").alias("type"))


def known_parts(canonical: str) -> str:
    """The words of an address before the @."""
    return f"split(substring_index({canonical}, '@', 1), '[._%+-]')"


def replacements(mentions: DataFrame, key: str | bytes) -> DataFrame:
    """(mention, alias, written): what stands for each mention, and for the names inside it that a text may go on with."""
    forms = mentions.withColumn("type", F.expr(_type("mention"))).where(F.expr(_genuine())).withColumn("canonical", F.expr(_canonical()))
    forms = cut(forms, "forms")
    words = cut(names_of(forms.where("type = 'name'")), "names")
    no_hint = F.lit(None).cast("string").alias("hint")
    # An address of two words is taken to be made of a name.
    persons = forms.where("type = 'email'").where(F.col("canonical").rlike(r"^\p{L}{2,40}[._]\p{L}{2,40}@")).select("mention", F.posexplode(F.split(F.substring_index("canonical", "@", 1), "[._]")).alias("pos", "part"))
    persons = cut(persons, "names-in-addresses")
    asked = words.select("type", "canonical").union(persons.select(F.lit("name"), "part")).distinct()
    named = cut(surrogates(asked.select("type", "canonical", no_hint), key), "name-surrogates")
    # An address made of words of names is made of their surrogates.
    mails = forms.where("type = 'email'").select("canonical").distinct().withColumn("part", F.explode(F.expr(known_parts("canonical"))))
    word = named.groupBy(F.col("canonical").alias("part")).agg(F.min(F.struct(F.col("type") == "name", "surrogate"))["surrogate"].alias("surrogate"))
    hints = mails.join(word, "part").groupBy("canonical").agg(F.map_from_entries(F.collect_set(F.struct("part", "surrogate"))).alias("known"))
    parts, seps = known_parts("canonical"), r"regexp_extract_all(substring_index(canonical, '@', 1), '[._%+-]', 0)"
    hint = f"array_join(transform({parts}, (p, i) -> concat(coalesce(try_element_at(known, p), IF(p rlike '[0-9]', p, ''), p), coalesce(get({seps}, i), ''))), '')"
    hints = hints.select("canonical", F.expr(hint).alias("hint"))
    other = forms.where("type <> 'name'")
    asked = other.select("type", "canonical").distinct().join(hints.withColumn("type", F.lit("email")), ["type", "canonical"], "left")
    given = surrogates(asked, key)
    plain = other.join(given, ["type", "canonical"]).select("mention", F.col("mention").alias("alias"), F.expr(_written()).alias("written"))
    beside = persons.join(word, "part").groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("pos", F.initcap("part").alias("old"), F.initcap("surrogate").alias("new")))).alias("w"))
    joined = lambda c: F.array_join(F.transform("w", lambda w: w[c]), " ")
    plain = plain.union(beside.select("mention", joined("old").alias("alias"), joined("new").alias("written")))
    drawn = words.join(named, ["type", "canonical"]).withColumn("drawn", F.expr(_cased("word", "surrogate")))
    people = drawn.groupBy("mention", "title").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "drawn"))).alias("w"))
    people = people.withColumns({"name": F.array_join(F.transform("w", lambda w: w["word"]), " "), "new": F.array_join(F.transform("w", lambda w: w["drawn"]), " ")})
    alias = lambda a, b: F.array(F.struct(a.alias("alias"), b.alias("written")))
    aliases = F.concat(alias(F.col("mention"), F.concat("title", "new")), alias(F.col("name"), F.col("new")), F.transform("w", lambda w: F.struct(w["word"].alias("alias"), w["drawn"].alias("written"))))
    return plain.union(people.select("mention", F.explode(aliases).alias("a")).select("mention", "a.alias", "a.written"))


def key_of(spark: SparkSession) -> str:
    """The key that the caller's session names, or one for demonstrations."""
    return spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY)


def pseudonymise(docs: DataFrame, key: str | bytes) -> DataFrame:
    """docs with every entity of `text` replaced, and a column n_entities.

    key: kept by the caller; who has it can tell which surrogate a given entity gets. A null
    text stays null and has none, an empty one stays empty; texts of any length are read
    whole; rows that repeat are replaced alike; other columns pass as they are, whatever
    their names (one named n_entities is replaced). An empty table gives none. Matches that
    fail their type's test (a card number's check digit, an octet over 255) stay. A name
    that neither a title nor an introduction tells is replaced where its text has it with
    one, or has an address made of it.
    """
    # The costly pattern runs over every text once; the rows are written with what it found.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = F.when(F.col("text").rlike(GATE), F.regexp_extract_all("text", F.lit(ANY), 0))
    read = cut(docs.select(row, found.alias("found")), "found-entities")
    text = F.col("row")["text"]
    touched = F.coalesce(F.size("found"), F.lit(0)) > 0
    # Texts are told apart by 128 bits of hash; what replaces an entity depends on the text alone.
    hits = read.where(touched).withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})
    met = cut(hits.select("k1", "k2", F.explode(F.array_distinct("found")).alias("mention")).distinct(), "mentions")
    given = cut(replacements(met.select("mention").distinct(), key), "written")
    per_text = met.join(given, "mention").groupBy("k1", "k2", "alias").agg(F.min("written").alias("written"), F.bool_or(F.col("alias") != F.col("mention")).alias("named"))
    entries = F.map_from_entries(F.collect_list(F.struct("alias", "written"))).alias("map")
    names = F.array_sort(F.collect_list(F.when(F.col("named"), F.struct((-F.length("alias")).alias("n"), "alias")))).alias("names")
    by_text = cut(per_text.groupBy("k1", "k2").agg(entries, names), "replacements")
    joined = hits.join(by_text, ["k1", "k2"], "left")
    # Names that go on without a title, the longest first. They are letters, blanks, hyphens and apostrophes only.
    untitled = F.concat(F.lit(f"{ANY}|{START}(?:"), F.array_join(F.transform("names", lambda n: n["alias"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    goes_on = F.coalesce(F.size("names"), F.lit(0)) > 0
    filled = joined.withColumns({
        "gaps": F.when(goes_on, F.split(text, untitled, -1)).otherwise(F.split(text, ANY, -1)),
        "found": F.when(goes_on, F.regexp_extract_all(text, untitled, F.lit(0))).otherwise(F.col("found")),
    })
    n = F.coalesce(F.size(F.filter("found", lambda m: F.try_element_at("map", m).isNotNull())), F.lit(0)).cast("long")
    new = F.expr("array_join(transform(gaps, (g, i) -> concat(g, coalesce(try_element_at(map, get(found, i)), get(found, i), ''))), '')")
    changed = filled.select("row", F.struct(new.alias("text"), n.alias("n")).alias("new"))
    same = read.where(~touched).select("row", F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")).alias("new"))
    out = changed.union(same)
    return out.select(*[(F.col("new.text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c != "n_entities"], F.col("new.n").alias("n_entities"))
