"""Operator 5: surrogates for personal data and secrets, with DataFrame functions only.

One expression finds the entities of a text, another gives each its kind and canonical form (digits of a card or phone,
lower case of an address), so that differently written mentions of one entity corefer. A name behind a title counts word by
word: the last word is a surname, the others are given names of the title's gender, so "Mr John Smith" and "Herr Smith" keep
one surname. Every distinct entity gets a surrogate drawn by a keyed hash: same kind, length and layout, another character
at each place, and what is checked stays right: Luhn's digit of a card, modulo 97 of an IBAN, numbers of an address below
256. The country of an IBAN or phone, the ending of a domain, the mark at the head of an access key, the gender of a given
name and the script of a name stay. Surrogates that coincide with another entity's, or with any real entity of the corpus, are
drawn again until none does; so different entities stay different. Where a shape has too few forms for its entities, later
draws are longer. The layout of each mention (spaces, brackets, capitals) is kept around the surrogate.

Not found: names without a title in front of them. Initials get another letter, which need not differ from other initials'.

Cases: a null text stays null, an empty one empty; a text without entities is returned as it is; an empty table gives
no rows; rows listed twice get equal results; a row without doc_id is handled as any other; columns of any name are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed

# Titles before a name with the gender they tell (n: none), particles inside names.
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Lord": "m", "Herr": "m", "Monsieur": "m", "Signor": "m", "Señor": "m", "Господин": "m", "Κύριος": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Signora": "f", "Señora": "f", "Señorita": "f", "Госпожа": "f", "Κυρία": "f", "Dr": "n", "Prof": "n"}
PARTICLES = "von van der den de di da del la le el al bin".split()
# Syllables for names by script and gender, letters for names in other scripts.
HEADS = {"latin": ["Al", "Bren", "Cor", "Dar", "El", "Fen", "Gar", "Hal", "Ir", "Jor", "Kel", "Lor", "Mar", "Nor", "Or", "Per"], "cyrillic": ["Ал", "Бор", "Вер", "Гор", "Дан", "Ев", "Жан", "Зор", "Ил", "Кир", "Лад", "Мар", "Ник", "Ост", "Пав", "Рад"], "greek": ["Αλ", "Βασ", "Γερ", "Δαμ", "Ελ", "Ζην", "Θεο", "Ιερ", "Καλ", "Λεο", "Μαρ", "Νικ", "Ξεν", "Ορ", "Πετ", "Ρεν"]}
MIDDLES = {"latin": ["a", "be", "di", "en", "fo", "ga", "hi", "il", "jo", "ka", "le", "mi", "no", "ol", "pe", "ri"], "cyrillic": ["а", "бе", "ви", "го", "де", "жа", "зи", "ил", "ко", "ла", "ми", "но", "ол", "пе", "ри", "са"], "greek": ["α", "βε", "γι", "δο", "ε", "ζα", "θι", "ιλ", "κο", "λα", "μι", "νο", "ξε", "πι", "ρα", "σε"]}
TAILS = {"latin_m": ["son", "ton", "ric", "ius", "mund", "bert", "win", "dor"], "latin_f": ["ina", "ela", "issa", "ora", "ette", "ine", "anna", "ia"], "latin_s": ["er", "man", "ley", "field", "ski", "ward", "well", "berg"], "cyrillic_m": ["слав", "мир", "дор", "ан", "ий", "ей", "тин", "сим"], "cyrillic_f": ["слава", "мира", "дора", "ана", "ия", "ея", "тина", "сима"], "cyrillic_s": ["ов", "ин", "ев", "ский", "енко", "ук", "ян", "ич"], "greek_m": ["ος", "ης", "ας", "ων", "ιος", "εας", "ανος", "ινος"], "greek_f": ["α", "η", "ια", "ινα", "ανη", "ουλα", "ιδα", "εια"], "greek_s": ["ιδης", "οπουλος", "ακης", "ου", "ατος", "ελης", "ινος", "αρας"]}
LETTERS = {"arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", "hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호", "han": "安博成德恩方光海嘉建杰康丽明宁平青荣思文晓欣雅义远志中子"}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}", "hangul": r"\p{IsHangul}", "han": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"}
# Heads of access keys, which stay, and the lengths of telephone country codes.
KEY_HEADS = r"AKIA|ASIA|sk-|gh[oprsu]_|xox[abprs]-|AIza"
COUNTRY_CODE = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}"
SECRET = rf"(?<![0-9A-Za-z])(?:[0-9a-f]{{24,128}}|[0-9A-F]{{24,128}}|(?:{KEY_HEADS})[0-9A-Za-z_-]{{12,128}})(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])"
NAME = r"(?:\p{Lu}\.|\p{Lu}[\p{L}\p{M}'’-]+|\p{Lo}[\p{Lo}\p{M}]*)"
TITLED = r"(?<![\p{L}\p{N}])(?:" + "|".join(TITLES) + r")\.? "
PERSON = TITLED + NAME + r"(?: (?:(?:" + "|".join(PARTICLES) + r") )*" + NAME + r"){0,4}"
#: The words of a name that are replaced: all that begin with a capital or are of a script without capitals.
NAME_WORD = r"(?<![\p{L}\p{M}])[\p{Lu}\p{Lo}][\p{L}\p{M}]*"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "card": CARD, "ssn": SSN, "ip": IPV4, "phone": PHONE, "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
HINT = rf"[0-9@]|{KEY_HEADS}|" + "|".join(f"{t}\\.? " for t in TITLES)
#: Draws after which surrogates get longer, one character every other draw, so that no shape is used up.
PATIENCE, DRAWS = 12, 96


def kind_of(raw: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        test = raw.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out.otherwise(F.lit("phone"))


def canonical(kind: Column, raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    phone = F.concat(F.when(raw.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits)
    return F.when(kind == "email", F.lower(raw)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", phone).when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(raw)


def drawn(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that follow from the key, the entity and the attempt."""
    seed = F.concat_ws("\u001f", F.lit(key), kind, name, attempt.cast("string"))
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("#")), 512))


def number(hexes: Column, at: Column | int, width: int = 2) -> Column:
    start = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(hexes, (start * 2 % (256 - width)).cast("int") + 1, F.lit(width)), 16, 10).cast("int")


def shaped(text: Column, hexes: Column, offset: int = 0) -> Column:
    """Each digit and letter for another one of its class; everything else stays."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def one(c: Column, i: Column) -> Column:
        n = number(hexes, i + offset)
        digit = ((c.try_cast("int") + 1 + n % 9) % 10).cast("string")

        def letter(alphabet: str) -> Column:
            return F.substring(F.lit(alphabet), (F.ascii(c) - ord(alphabet[0]) + 1 + n % 25) % 26 + 1, F.lit(1))

        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), letter(letters)).when(c.rlike("[A-Z]"), letter(letters.upper())).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def modulo_97(text: Column) -> Column:
    """The remainder of a number whose letters stand for 10 to 35."""

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), (rest * 100 + letter) % 97).otherwise((rest * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of digits that a check digit will follow."""
    values = F.reverse(F.split(digits, ""))
    doubled = F.transform(values, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def surrogate(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """A draw for an entity; ``name`` is the column canon. Kinds of name words are name_m, name_f, name_n and name_s (surname)."""
    h = drawn(key, kind, name, attempt)
    longer = F.greatest(F.lit(0), (attempt - PATIENCE) / 2).cast("int")
    more = F.substring(F.conv(F.substring(h, 200, 12), 16, 10), F.lit(1), longer)
    domain = F.substring_index(name, "@", -1)
    site, ending = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    email = F.concat(shaped(F.substring_index(name, "@", 1), h), more, F.lit("@"), shaped(site, drawn(key, F.lit("domain"), domain, F.lit(0))), F.lit("."), ending)
    head = F.concat(F.substring(name, 1, 1), shaped(F.expr("substring(canon, 2, length(canon) - 2)"), h), more)
    check = F.when(F.coalesce(F.call_function("luhn_check", name), F.lit(False)), ((10 - luhn_sum(head) % 10) % 10).cast("string")).otherwise((number(h, 100) % 10).cast("string"))
    card = F.concat(head, check)
    mark = F.regexp_extract(name, f"^(?:{KEY_HEADS})", 0)
    hexes = F.substring(h, 1, F.length(name))
    secret = F.when(mark != "", F.concat(mark, shaped(F.expr("substring(canon, length(regexp_extract(canon, '^(?:" + KEY_HEADS + ")', 0)) + 1)"), h))).when(name.rlike("[A-F]"), F.upper(hexes)).otherwise(hexes)
    ip = F.concat_ws(".", *[(number(h, 4 * i, 4) % 254 + 1).cast("string") for i in range(4)])
    code = F.regexp_extract(name, f"^{COUNTRY_CODE}", 0)
    phone = F.concat(code, shaped(F.expr(f"substring(canon, length(regexp_extract(canon, '^{COUNTRY_CODE.replace(chr(92), chr(92) * 2)}', 0)) + 1)"), h), more)
    account = F.concat(shaped(F.expr("substring(canon, 5)"), h), more)
    country = F.substring(name, 1, 2)
    checked = F.lpad((98 - modulo_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    other = F.concat(shaped(name, h), more)
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "phone", phone)
        .when(kind.startswith("name"), name_drawn(kind, name, h, longer)).when(kind == "iban", F.concat(country, checked, account)).otherwise(other)
    )


def name_drawn(kind: Column, name: Column, h: Column, longer: Column) -> Column:
    """A name word of the same script: syllables that tell the gender, or as many letters where the script has no capitals."""
    script = F.lit("latin")
    for one, pattern in SCRIPTS.items():
        script = F.when(name.rlike(pattern), F.lit(one)).otherwise(script)

    def table(parts: dict) -> Column:
        return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])

    def pick(parts: dict, which: Column, at: Column | int) -> Column:
        choices = F.try_element_at(table(parts), which)
        return F.try_element_at(choices, number(h, at) % F.size(choices) + 1)

    gender = F.when(kind == "name_s", "s").when(kind == "name_f", "f").when(kind == "name_m", "m").otherwise(F.when(number(h, 90) % 2 == 0, "m").otherwise("f"))
    middles = F.array_join(F.transform(F.sequence(F.lit(0), longer + 1), lambda i: pick(MIDDLES, script, i + 1)), "")
    told = F.concat(pick(HEADS, script, 0), middles, pick(TAILS, F.concat_ws("_", script, gender), 60))
    alphabet = F.try_element_at(F.create_map(*[x for k, v in LETTERS.items() for x in (F.lit(k), F.lit(v))]), script)
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.length(name) + longer), lambda i: F.substring(alphabet, number(h, i) % F.length(alphabet) + 1, F.lit(1))), "")
    return F.when(alphabet.isNotNull(), letters).otherwise(told)


def dressed(kind: Column, raw: Column, name: Column) -> Column:
    """The surrogate in the mention's layout."""
    plain = F.regexp_replace(name, r"^\+", "")

    def put(state: Column, c: Column) -> Column:
        taken = c.rlike("[0-9A-Z]")
        return F.struct((state["k"] + taken.cast("int")).alias("k"), F.concat(state["out"], F.when(taken, F.substring(plain, state["k"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    laid = F.aggregate(F.split(raw, ""), F.struct(F.lit(0).alias("k"), F.lit("").alias("out")), put, lambda s: F.concat(s["out"], F.substring(plain, s["k"] + 1, F.length(plain))))
    capitals = (raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1)
    return F.when(kind.isin("card", "ssn", "phone", "iban"), laid).when(kind.isin("email", "name_m", "name_f", "name_n", "name_s") & capitals, F.upper(name)).otherwise(name)


def mentions(docs: DataFrame) -> DataFrame:
    """(doc, pos, part, last, kind, raw, canon): what is found in each text; doc is a hash of doc_id and text, equal for rows listed twice.

    A person's name has one row for each of its words (part), all others have one.
    """
    found = docs.where(F.col("text").rlike(HINT)).select(row_key().alias("doc"), F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(ANY), F.lit(0))).alias("pos", "whole"))
    found = found.withColumn("is", kind_of(F.col("whole")))
    words = F.regexp_extract_all(F.regexp_replace("whole", f"^{TITLED}", ""), F.lit(NAME_WORD), F.lit(0))
    found = found.withColumn("words", F.when(F.col("is") == "person", words).otherwise(F.array("whole"))).select("doc", "pos", "whole", "is", F.size("words").alias("n"), F.posexplode("words").alias("part", "raw"))
    gender = F.try_element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.regexp_extract("whole", r"^[\p{L}]+", 0))
    named = F.when((F.length("raw") == 1) & F.col("raw").rlike(r"\p{Lu}"), "initial").when(F.col("part") == F.col("n") - 1, "name_s").otherwise(F.concat(F.lit("name_"), gender))
    found = found.withColumn("kind", F.when(F.col("is") == "person", named).otherwise(F.col("is")))
    canon = F.when(F.col("is") == "person", F.lower("raw")).otherwise(canonical(F.col("kind"), F.col("raw")))
    return found.select("doc", "pos", "part", "whole", "kind", "raw", canon.alias("canon"))


def row_key() -> Column:
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.xxhash64("text").cast("string"))


def family(kind: Column) -> Column:
    """Surrogates differ within a family of kinds: all names are one."""
    return F.when(kind.startswith("name"), F.lit("name")).otherwise(kind)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, fake) for distinct (kind, canon): fakes differ from each other and from every real entity, whatever their capitals."""
    todo = checkpointed(entities.select("kind", "canon").distinct())
    real = todo.select(family(F.col("kind")).alias("rk"), F.lower("canon").alias("rc")).distinct()
    current = todo.withColumn("attempt", F.lit(0)).withColumn("fake", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
    current = checkpointed(current)
    for _ in range(DRAWS):
        rank = F.row_number().over(Window.partitionBy(family(F.col("kind")), F.lower("fake")).orderBy("attempt", "kind", "canon"))
        judged = current.withColumn("rank", rank).join(real, (family(F.col("kind")) == F.col("rk")) & (F.lower("fake") == F.col("rc")), "left")
        judged = checkpointed(judged.withColumn("bad", (F.col("rank") > 1) | F.col("rc").isNotNull()).drop("rk", "rc", "rank"))
        if not judged.where("bad").limit(1).count():
            break
        again = judged.where("bad").withColumn("attempt", F.col("attempt") + 1).withColumn("fake", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        current = checkpointed(judged.where("NOT bad").drop("bad").unionByName(again.drop("bad")))
    return current.select("kind", "canon", "fake")


def replaced(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, and, if asked for, the number of entities in a further column.

    No Python runs on the executors.
    """
    found = checkpointed(mentions(docs))
    fakes = surrogates(found.where("kind <> 'initial'"), key)
    initial = F.upper(shaped(F.upper("canon"), drawn(key, F.lit("initial"), F.col("canon"), F.lit(0))))
    ready = found.join(fakes, ["kind", "canon"], "left").withColumn("fake", F.coalesce(dressed(F.col("kind"), F.col("raw"), F.col("fake")), initial))
    parts = ready.groupBy("doc", "pos").agg(F.transform(F.sort_array(F.collect_set(F.struct("part", "fake"))), lambda x: x["fake"]).alias("fakes"), F.first("whole").alias("whole"), F.max(F.col("kind").startswith("name") | (F.col("kind") == "initial")).alias("person"))
    title = F.regexp_extract("whole", f"^{TITLED}", 0)
    named = F.concat(title, woven(F.expr("substring(whole, length(title) + 1)"), NAME_WORD, F.col("fakes")))
    whole = parts.withColumn("title", title).select("doc", "pos", F.when(F.col("person"), named).otherwise(F.col("fakes")[0]).alias("fake"))
    per = whole.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "fake"))), lambda x: x["fake"]).alias("fakes"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text", row_key().alias("key"))
    joined = rows.join(per, F.col("key") == F.col("doc"), "left")
    out = joined.select("row", "fakes", F.when(F.col("fakes").isNull(), F.col("text")).otherwise(woven(F.col("text"), ANY, F.col("fakes"))).alias("text"))

    def column(c: str) -> Column:
        if c == "n_chars" and "text" in docs.columns:
            return F.when(F.col("fakes").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)).alias(c)
        return F.col("text") if c == "text" else F.col(f"row.`{c}`")

    counted = [F.coalesce(F.size("fakes"), F.lit(0)).cast("long").alias(count)] if count else []
    return out.select(*(column(c) for c in docs.columns), *counted)


def woven(text: Column, pattern: str, fakes: Column) -> Column:
    """The text with the matches of a pattern replaced one by one."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), fakes, lambda gap, fake: F.concat(gap, F.coalesce(fake, F.lit("")))), "")
