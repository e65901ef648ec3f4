"""PII: detected entities get keyed surrogates of the same type and format, in DataFrame functions only.

Detected are e-mail addresses, IPv4 addresses, phone numbers (after a plus sign in any groups, else (ddd) ddd-dddd,
ddd-ddd-dddd, and after a 0 an area with one or two groups or five pairs), card, social security and bank account
numbers, secrets (after token, password and the like; key ids; hexadecimal strings of 32 or more, with digits and
letters) and names after a
title with all their capitalised parts. None of these has an upper length but by its own rules (an account number's 34).
Texts of any length are searched whole, in time that grows in proportion. An entity's
form for comparison is lower case, for numbers the digits alone, so that all its mentions get one surrogate
(coreference). Surrogates come from SHA-256 over key, type, form and attempt: digits become digits, letters
letters, hexadecimal letters hexadecimal letters, in the case and with the separators of the mention; the top-level
domain, the country code and the first digit of a card stay, the card's check digit is made to fit; an address
stays a valid address; a name keeps gender, script (Latin, Cyrillic, Greek or Armenian; in any other it becomes
Latin) and number of parts. Where a table holds about as many entities of a form as the form has values, the
last ones get surrogates that are longer than the form.

Distinct entities keep distinct surrogates, and none is an entity of the table: those for which that fails,
except the first of several, are drawn again until all hold (collision check over the distinct entities).

Defined results: a null text stays null and an empty one empty, without entities; texts without entities stay as
they are; equal rows get equal results; an empty table gives an empty table; other columns are carried along.
A mention that occurs in a third of all texts is one row of the entity table, and the join back to the mentions
may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace

# The forms of entities. Possessive repeats without upper ends where a form has none, and a start that can't lie
# within a longer run, keep the search linear on any text.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[A-Za-z0-9])[A-Za-z0-9.-]+\.[A-Za-z]{2,}+"
IPV4 = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
#: A plus sign and 8 to 15 digits in any groups, with up to three signs between digits; where the run is longer, groups of
#: 2-4 digits, or else what of it has 15 digits at most and ends with a group. Without a plus sign two forms.
_APART = r"[ .()/\u00A0\u2011\u202F-]{0,3}"
PHONE_PLUS = rf"(?<![\p{{L}}\p{{N}}+])\+(?:\d(?:{_APART}+\d){{7,14}}+(?!{_APART}\d)|\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]\d{{2,4}}){{1,4}}(?!\d)|\d{{8,15}}(?!\d)|\d(?:{_APART}\d){{7,14}}(?!\d))"
PHONE_BRACKET = r"(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
PHONE_PLAIN = r"(?<![\p{L}\p{N}]|\d-)(?:1-)?\d{3}-\d{3}-\d{4}(?![\p{L}\p{N}]|-\d)"
#: National numbers after a 0: an area and one or two groups, or pairs of digits.
PHONE_ZERO = r"(?<![\p{L}\p{N}.,/+-])(?:\(0[1-9]\d{1,3}\) ?\d{3,8}|0[1-9]\d{1,3}[ /-]\d{5,8}|0[1-9]\d{1,3} \d{3,4} \d{3,4}|0[1-9](?<pair>[ .])\d{2}(?:\k<pair>\d{2}){3}(?!\k<pair>\d))(?![\p{L}\p{N}]|[.,-]\d)"
#: Country codes; those of three digits are all others.
COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CARD = r"(?<![\p{L}\p{N}])\d{4}(?<between>[ -]?)\d{4}\k<between>\d{4}\k<between>\d{4}(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
NAMED = r"(?i:token|password|passwd|secret|api[_-]?key)\s*+[=:]\s*+[\"']?[A-Za-z0-9_./+-]{8,}+"
KEY_ID = r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])"
HEX = r"(?<![\p{L}\p{N}])(?=[a-fA-F]*+\d)(?=\d*+[a-fA-F])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])"
TITLES = {"m": ["Mr", "Herr", "Señor", "Monsieur", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "г-жа"]}
PARTICLES = ["van", "von", "der", "den", "de", "di", "da", "del", "la", "le", "du", "ten", "ter", "zu", "al", "bin", "ibn"]
NAME = r"(?<![\p{L}\p{N}])(?:%s)\.? (?:(?:%s) )*+\p{Lu}[\p{L}'’-]++(?: (?:(?:%s) )*+\p{Lu}[\p{L}'’-]++)*+" % ("|".join(TITLES["m"] + TITLES["f"]), "|".join(PARTICLES), "|".join(PARTICLES))

#: In the order in which they are tried. A look at the next character, cheaper than the look behind that follows,
#: rules most places out.
TYPES = {
    "email": EMAIL,
    "secret": f"{NAMED}|(?=A)(?:{KEY_ID})|(?=[0-9a-fA-F])(?:{HEX})",
    "ipv4": rf"(?=\d)(?:{IPV4})",
    "phone": rf"(?=\+)(?:{PHONE_PLUS})|(?=\()(?:{PHONE_BRACKET})|(?=\d)(?:{PHONE_PLAIN})|(?=[0(])(?:{PHONE_ZERO})",
    "iban": f"(?=[A-Z])(?:{IBAN})",
    "card": rf"(?=\d)(?:{CARD})",
    "ssn": rf"(?=\d)(?:{SSN})",
    "name": f"(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts}))}])(?:{NAME})",
}

# Names by script and gender, family names in two halves.
GIVEN = {
    "latin": {
        "m": "Adam Albert Anton Bruno Carl Daniel David Edgar Emil Erik Felix Frank Georg Gustav Hans Hugo Ivan Jakob Jonas Karl Leon Louis Marco Martin Nils Oscar Otto Paul Peter Simon Thomas Victor".split(),
        "f": "Ada Agnes Alma Anna Berta Carla Clara Diana Edith Elena Emma Eva Frida Greta Hanna Helena Ida Irene Julia Karin Laura Lena Lucia Maria Martha Nora Olga Paula Rosa Sara Sophie Vera".split(),
    },
    "cyrillic": {
        "m": "Антон Борис Вадим Виктор Глеб Давид Денис Егор Иван Игорь Кирилл Лев Максим Никита Олег Павел".split(),
        "f": "Алла Анна Вера Галина Дарья Елена Зоя Инна Ирина Ксения Лидия Мария Нина Ольга Раиса Софья".split(),
    },
    "greek": {
        "m": "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Μάριος Νίκος".split(),
        "f": "Άννα Βάσω Ελένη Ζωή Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    },
    "armenian": {
        "m": "Արամ Արմեն Գարիկ Դավիթ Հայկ Սարգիս Տիգրան Վահան".split(),
        "f": "Աննա Անի Գայանե Լիլիթ Մարիամ Նարե Սոնա Շուշան".split(),
    },
}
FAMILY = {
    "latin": ("Al Ber Cor Dal Es Fer Gar Hal Is Jor Kel Lan Mar Nor Or Par".split(), "den field gard holm ing land man ner quist rell sen ston ter ville win by".split()),
    "cyrillic": ("Бор Вол Гор Дан Ерш Зор Кар Лук".split(), "ин ов аев енко ский ун ич ко".split()),
    "greek": ("Αλεξ Βασ Γεωρ Δημ Καλ Μαρ Παπ Σταυρ".split(), "άκης όπουλος ίδης άτος έας ίου άκος ούλης".split()),
    "armenian": ("Աբ Բար Գրիգ Դան Կար Մար Պետ Սար".split(), "յան ունի ենց ոսյան ակյան իկյան ումյան եսյան".split()),
}
#: Draws after which a surrogate has a character more with each draw.
SAME_LENGTH = 4
_LETTERS = "qwertyuiopasdfgh"


def pattern() -> str:
    """One pattern for all types."""
    return "|".join(f"(?:{p})" for p in TYPES.values())


def _digest(*parts: Column, length: Column) -> Column:
    """Hexadecimal digits: ``length`` of them at least."""
    base = F.sha2(F.concat_ws("\x1f", *parts), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(length / 64).cast("int")), lambda k: F.sha2(F.concat(base, k.cast("string")), 256))
    return F.array_join(blocks, "")


def _mapped(form: Column, digest: Column, hexadecimal: Column) -> Column:
    """Each digit and letter of a form becomes another of its kind; other characters stay."""
    # Both alphabets over the whole digest: a condition within the walk would be tested for each character.
    letters = F.when(hexadecimal, F.translate(digest, "0123456789", "abcdefabcd")).otherwise(F.translate(digest, "0123456789abcdef", _LETTERS))
    drawn = F.zip_with(F.split(F.translate(digest, "abcdef", "135790"), ""), F.split(letters, ""), lambda d, x: F.struct(d.alias("d"), x.alias("x")))
    drawn = F.slice(drawn, F.lit(1), F.length(form))
    return F.array_join(F.zip_with(F.split(form, ""), drawn, lambda c, d: F.when(c.between("0", "9"), d.d).when(c.rlike(r"\p{L}"), d.x).otherwise(c)), "")


def _check_digit(digits: Column) -> Column:
    """The digit that completes a number by the usual doubling scheme."""
    n = F.length(digits)
    doubled = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10) % 10).cast("string")


def _pick(values: list[str], digest: Column, at: Column) -> Column:
    number = F.conv(F.substr(digest, at, F.lit(6)), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _name(form: Column, digest: Column, attempt: Column) -> Column:
    """form: gender, script and parts, with spaces between. A given name for each part but the last; the family name
    has a part more after every second attempt, so that there are always enough."""
    parts, out = F.size(F.split(form, " ")) - 2, F.lit(None).cast("string")
    at = lambda k: (k * 12 + 1).cast("int")
    for script in GIVEN:
        front, back = FAMILY[script]
        family = F.transform(F.sequence(F.lit(0), F.floor(attempt / 2).cast("int")), lambda k: F.concat(_pick(front, digest, at(k)), _pick(back, digest, at(k) + 6)))
        family = F.array_join(family, "-")
        for gender in GIVEN[script]:
            given = F.transform(F.sequence(F.lit(2), parts), lambda k: _pick(GIVEN[script][gender], F.reverse(digest), at(k)))
            here = F.when(parts > 1, F.concat(F.array_join(given, " "), F.lit(" "), family)).otherwise(family)
            out = F.when(form.startswith(f"{gender} {script} "), here).otherwise(out)
    return out


def staged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the columns of ``df`` as one, so that no name meets another), __k1 and __k2 (for id and text, never
    null), __raw (the entities) and __some (1 if there are any)."""
    text = df[text_col].cast("string")
    keyed = df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), F.xxhash64(df[id_col], text).alias("__k1"), F.xxhash64(text, F.lit(1)).alias("__k2"), F.regexp_extract_all(text, F.lit(pattern()), F.lit(0)).alias("__raw"))
    return keyed.withColumn("__some", F.when(F.size("__raw") > 0, 1).otherwise(0))


def mentions(having: DataFrame) -> DataFrame:
    """__k1, __k2, at, raw, head (what of raw stays), type, form."""
    rows = having.select("__k1", "__k2", "__raw").dropDuplicates(["__k1", "__k2"]).select("__k1", "__k2", F.posexplode("__raw").alias("at", "raw"))
    raw = F.col("raw")
    kind = F.lit(None).cast("string")
    for name, form in reversed(TYPES.items()):
        kind = F.when(raw.rlike(f"^(?:{form})$"), F.lit(name)).otherwise(kind)
    rows = rows.withColumn("type", kind)
    titles = "|".join(TITLES["m"] + TITLES["f"])
    named = r"^(?i:token|password|passwd|secret|api[_-]?key)\s*+[=:]\s*+[\"']?"
    head = F.when(F.col("type") == "secret", F.regexp_extract(raw, f"({named}|^AKIA|^)", 1)).when(F.col("type") == "name", F.regexp_extract(raw, rf"^((?:{titles})\.? )", 1)).when(F.col("type") == "phone", F.regexp_extract(raw, rf"^({COUNTRY}|1-|\(?0|)", 1)).otherwise(F.lit(""))
    rows = rows.withColumn("head", head)
    body = F.expr("substring(raw, length(head) + 1)")
    gender = F.when(F.col("head").rlike("^(?:%s)" % "|".join(rf"{t}\.? " for t in TITLES["m"])), F.lit("m")).otherwise(F.lit("f"))
    script = F.lit("latin")
    for other in ("cyrillic", "greek", "armenian"):
        script = F.when(body.rlike(rf"\p{{Is{other.title()}}}"), F.lit(other)).otherwise(script)
    form = F.when(F.col("type").isin("phone", "card", "ssn"), F.regexp_replace(body, r"\D", "")).when(F.col("type") == "iban", F.lower(F.regexp_replace(body, " ", ""))).when(F.col("type") == "name", F.concat_ws(" ", gender, script, F.lower(body))).otherwise(F.lower(body))
    return rows.withColumn("form", form)


def _surrogates(entities: DataFrame, key: str) -> DataFrame:
    """type, form, attempt -> with the surrogate of the form."""
    form, kind, attempt, grown = F.col("form"), F.col("type"), F.col("attempt"), F.col("grown")
    # After some draws the form grows: each more multiplies the space that the next ones are drawn from. What is
    # used several times is a column, so that it is computed once.
    out = entities.withColumn("grown", F.greatest(attempt - SAME_LENGTH, F.lit(0)).cast("int"))
    enough = F.greatest(F.length(form), 12 * (attempt + F.size(F.split(form, " ")) + 4)) + grown
    out = out.withColumn("digest", _digest(F.lit(key), kind, form, attempt.cast("string"), length=enough))
    digest, plain = F.col("digest"), F.lit(False)
    local, domain, tld = F.concat(F.substring_index(form, "@", 1), F.repeat(F.lit("x"), grown)), F.regexp_extract(form, r"@(.*)\.[^.]*$", 1), F.substring_index(form, ".", -1)
    email = F.concat(_mapped(local, digest, plain), F.lit("@"), _mapped(domain, _digest(F.lit(key), F.lit("domain"), domain, length=F.length(domain)), plain), F.lit("."), tld)
    octet = lambda k: F.conv(F.substring(digest, 8 * k + 1, 6), 16, 10).cast("long")
    more = F.when(grown > 0, F.concat(F.lit("."), F.translate(F.substr(digest, F.lit(40), grown), "abcdef", "123456"))).otherwise("")
    ipv4 = F.concat(F.concat_ws(".", *[(octet(k) % 254 + 1).cast("string") for k in range(4)]), more)
    longer = F.concat(form, F.repeat(F.when(kind == "secret", F.lit("a")).otherwise(F.lit("0")), grown))
    whole = F.when(~kind.isin("email", "ipv4", "name"), _mapped(longer, digest, (kind == "secret") & form.rlike("^[0-9a-f]+$")))
    out = out.withColumn("mapped", whole)
    mapped = F.col("mapped")
    card = F.concat(F.substring(form, 1, 1), F.expr("substring(mapped, 2, length(mapped) - 2)"))
    iban = F.concat(F.substring(form, 1, 2), F.expr("substring(mapped, 3)"))
    surrogate = F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "card", F.concat(card, _check_digit(card))).when(kind == "iban", iban).when(kind == "name", _name(form, digest, attempt)).otherwise(mapped)
    return out.withColumn("surrogate", surrogate).select("type", "form", "attempt", "surrogate")


def entity_table(found: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """type, form, surrogate: one row an entity; surrogates are distinct, and none is an entity. Each turn draws
    again for those that failed. It ends whatever the table: past the first turns the space that a surrogate is
    drawn from grows by a factor of 6 at least with each turn (a part of a family name, a digit or a letter more),
    while those that fail get fewer, so that soon fewer than one in expectation is left."""
    forms = ws.keep(found.select("type", "form").distinct(), "forms")
    # Few bytes but much to compute: dealt over as many tasks as a shuffle has, whatever the size.
    tasks = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    # What a surrogate must not be: a name's form has gender and script before it.
    taken = forms.select("type", F.when(F.col("type") == "name", F.regexp_replace("form", r"^\S+ \S+ ", "")).otherwise(F.col("form")).alias("own")).distinct()
    table = ws.keep(_surrogates(forms.repartition(tasks, "form").withColumn("attempt", F.lit(0)), key), "entities-0")
    turn = 0
    while True:
        same = F.row_number().over(Window.partitionBy("type", F.lower("surrogate")).orderBy("attempt", "form"))
        real = table.join(taken.withColumnsRenamed({"type": "__t"}), (F.col("type") == F.col("__t")) & (F.lower("surrogate") == F.col("own")), "left")
        marked = real.withColumn("again", (same > 1) | F.col("own").isNotNull())
        again = ws.keep(marked.filter("again").select("type", "form", (F.col("attempt") + 1).alias("attempt")), f"again-{turn}")
        if again.isEmpty():
            return table
        turn += 1
        fine = marked.filter("not again").select("type", "form", "attempt", "surrogate")
        table = ws.keep(fine.union(_surrogates(again, key)), f"entities-{turn}")


def _rendered() -> Column:
    """The surrogate in the form of the mention: separators and case."""
    body = F.expr("substring(raw, length(head) + 1)")
    walk = F.aggregate(F.split(body, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), lambda a, c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(a.out, F.substr(F.col("surrogate"), a.k + 1, F.lit(1))).alias("out"), (a.k + 1).alias("k"))).otherwise(F.struct(F.concat(a.out, c).alias("out"), a.k.alias("k"))), lambda a: F.concat(a.out, F.substr(F.col("surrogate"), a.k + 1, F.lit(1 << 30))))
    separated = F.when(F.col("type").isin("phone", "card", "ssn", "iban"), walk).otherwise(F.col("surrogate"))
    cased = F.when(body.rlike(r"\p{L}") & (body == F.upper(body)), F.upper(separated)).otherwise(separated)
    # A secret may hold both cases, as ids do; each character then follows the mention's.
    by_character = F.array_join(F.zip_with(F.split(separated, ""), F.split(body, ""), lambda s, b: F.when(b == F.upper(b), F.upper(s)).otherwise(s)), "")
    return F.concat("head", F.when(F.col("type").isin("secret", "iban"), by_character).otherwise(cased))


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_name: str = "__entities") -> DataFrame:
    """The columns of ``df`` with surrogates in the text, and by ``count_name`` their number; a column of that name
    that ``df`` has gives way to it."""
    ws = Workspace(df.sparkSession, "pii")
    # Searched once. Texts without entities, most of them, aren't shuffled.
    stage = ws.keep(staged(df, id_col, text_col), "staged", by="__some")
    having = stage.filter("__some = 1")
    found = ws.keep(mentions(having), "mentions")
    table = entity_table(found, key, ws).select(F.col("type").alias("__t"), F.col("form").alias("__f"), "surrogate")
    replaced = found.join(table, (F.col("type") == F.col("__t")) & (F.col("form") == F.col("__f"))).select("__k1", "__k2", "at", _rendered().alias("new"))
    per_text = replaced.groupBy("__k1", "__k2").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("__new"))
    per_text = ws.keep(per_text.select(F.col("__k1").alias("__c1"), F.col("__k2").alias("__c2"), F.col("__new.new").alias("__new")), "replaced")
    joined = having.join(per_text, (having["__k1"] == per_text["__c1"]) & (having["__k2"] == per_text["__c2"]))
    kept = [c for c in df.columns if c.lower() != count_name.lower()]
    of = lambda c: F.col("doc").getField(c)
    between = F.split(of(text_col).cast("string"), pattern())
    whole = F.array_join(F.flatten(F.zip_with(between, F.col("__new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = joined.select(*[(whole if c == text_col else of(c)).alias(c) for c in kept], F.size("__new").cast("long").alias(count_name))
    same = stage.filter("__some = 0").select(*[(of(c).cast("string") if c == text_col else of(c)).alias(c) for c in kept], F.lit(0).cast("long").alias(count_name))
    return same.unionByName(changed)
