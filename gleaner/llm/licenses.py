"""Operator 7: canonical digests of whole texts, and of whole lines, looked up among known licence texts.

The canonical form has one spelling for letters' case, punctuation and white space, no copyright lines and one spelling
of words that licence guidelines hold to be equivalent. Its digest is joined by hash with the digests of the known
texts (short notices and excerpts in KNOWN, complete texts in WHOLE); that table is fixed with the code, so it is broadcast.

Cases: null and empty texts, and those of copyright lines only, have the canonical form "" and match nothing; an empty
table gives no rows; a row listed twice is reported twice; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known notices (identifier, text).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Digests of complete licence texts and notices in canonical form, by identifier; those that differ only in lines
# that begin with the word copyright, and so are dropped, come from wrapping a text at 60 to 100 columns, with its usual titles.
WHOLE = {
    "0BSD": "350f087c09f773dbf1e95772b1c826a7 a98398ea0c42c1f231641a7a47075188 fa9583358e39e30cc008a801c940fa8c".split(),
    "Apache-2.0": "144b7967891d99a420cebe46ce47bbc7 3f75cdec37a8a9cf2daa486022386970 80fd9072ff3abaac5ce5940ef25ed199 96e2f6a9dcc346917f6a6fb2bff883b5 9768e9ac0a2ddb298695e7c2ca9bfa36 db4fae888ce4068810986a16e5953e7a ff27ba34e8ac36ddab0cbf04160132c5".split(),
    "BSD-2-Clause": "05c3fa6826651b081fb1fb9e5f36d672 15b230d264ef97749ab8dea5baa056c9 2f5df223f3b13b285d54e3a2f11683a3 31223e2811073d26022a9ea259648af4 369be0093b2fc63b152c6b08433d7381 3a1465ab6cc0fd2f6545d312e1360389 3df0e91458e430a48c745b977bf59551 506ab38ea4fb0192b54d6096d06472a3 7156097767f5afef1724228b3dfb48fe 74e49317c87c313accad978065f53b4c 7733ce47950c88e38fa6d6854b9ce137 8433aac5861a12f28ca17154cac1b684 84bcc064395e7276bffdd0a37f6b3990 90af67d7512321b03d5c8f9814e2ad03 b0538ec125cafeeb58bf11083985630b c4d302a720dd210af52fceefd9f645af e92b37038b47972a44013741351d9500 febbf520905b7428e864955885d49ba2".split(),
    "BSD-3-Clause": "15981386e2cd3aa6e4a71d1889084b6a 22d101e755b8a71e8a1110668d841dd5 246dec098e5d378fa3ab0b755b70bf17 33fee351a152326bf253049a92deceff 351cec435e745150449d77b3f69baf2b 3f17b3d5fca872ee00732006ae968f45 3f8b91345e977dc62312302aa4b7b338 44e678abf3dad01cd2e48d1a8f218557 64421184de52ba6b114066816a09118d 747b9537a4cefe6cbf5202a59e7b1271 7e0af0339918b7c9f7523a1ba20fd8a5 9bbd7db5d381a6fe317fecadf6729d92 aa2ebb685324d9899923c2f1cf692ecb c245a9d439da9a8ea626ab19c280d998 ce68edc99871dcc412dce50d8d5c3a91 dfd9463b7bcad50bb1270be3d6bf0c2a e12a77b465e317cc794ba8b332363d19 f4bceb6c56b7c1c978c713cfaca5d16a".split(),
    "CC0-1.0": "dcb3226ed1c311f82507296410434b55".split(),
    "GPL-2.0": "1205d19876b06a7da35ebcc42d3b3870 13edfec52d310e54dd3afbf6e35aaebb e558566aa350611a1e116618b6d308dd".split(),
    "GPL-3.0": "36347d96637b685e58d1b90de70a85b8 58ac90e261beb8765e360647f26a09d3 d9cc6e7282a8a11d0133329580436a23 e1d8689f96dea72af598581a8d09c24c".split(),
    "ISC": "63179b48dd80764d198b18b1a4a65df0 9b4f6eddda8e34fea1fe9420ebff490a a28e0523130ff62bda5b02d13cbabb55 b6ab23f33a368e7f225abed7065c8009 c22af3909cee7fd7bba39db6020b278e c8a67b9a4b1a8aa30b1dd65368c84f80 dcd69494c56e26e8a04f3d6c3be6ff7a e8e1ea32eea60e02907d9d691a4153eb".split(),
    "LGPL-2.1": "0dd8723c5822f422d99a779043b5ed74 b0e44c745072418c0ff11407a0bc4ffc d3172d61e815bf74b55f2c1a0a637084".split(),
    "LGPL-3.0": "087dc82eb7c367aa4297b1f0bb1c2c21 ac2832e1c06052da003e8a47592923e0 b31b7335bc37919e8cdd79154e04d88d".split(),
    "MIT": "04ddd61083899c2a5ef03d9fe09b79c9 0654809a643792890ef9ad53036c8531 2886eb256547eeebf28ce83cd96be3dc 291eb393da74123ec9d90b768adb74b3 3081e53379d25b70c18f415d2a97fb5c 3f7ce81dd6ea43e9da04c91e6d46bc7c 42b1183431880a33590cc63ab4738953 5f8fb2ff217f38d2b30e6f5baaad1835 5fefeb84c2e262528a30c16c8f8d7a34 66dd1caf442553ce09fa72a9da2e8c0e 87da029a979185feb91a6830e1ade1e9 90a17991c3ba7b04d183a6467fbe3449 a22a6a19d4d5e9eda21ebba2a31ae56a a6e9fe4bea13287f5038fd9cc6844c9c b2de85e2ec459a7a83c025107bfe9080 c57c00559ef795f4117fb4825213e0ef d4c5f5a0da3d27e3a9dc10ef25e034f7 e81be6942f0fb4736b639a8d886d078f ebdf232d3ec105006865cdd35219b948 f3337087707816eadb4c727b81399a58".split(),
    "MPL-2.0": "095a4eef7dcdb54209f3e11fa005c37d 1b6ec1336b9401f1a528310a5c810210 9827c35216f8009dff41249ae52df7a3 ae6074a7a78b63bc8b5e94107fcaba93".split(),
    "Unlicense": "0ddb544fc94f1ac376b1b27618cf995a 2bbfee96e397c4bc296397856b4bccf8 a1dfde39ef8fa1f64db9cdb8dda02429 a8ec4f7d882021713cd0e5ffceba3397".split(),
}
# Spellings that count as equal (as found in canonical text, as it is written there).
EQUAL = [("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("v", "version"), ("and or", "and/or"), ("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("non commercial", "noncommercial"), ("per cent", "percent")]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"


# every known text has one of these in its canonical form, whatever stands between two words of it
HINT = r"licen[cs]e|cc[^\p{L}\p{N}]+by|permission|public[^\p{L}\p{N}]+domain|waived|redistribution|creative[^\p{L}\p{N}]+commons"
SPELLINGS = [(a, b.replace("/", " ")) for a, b in EQUAL if a != b.replace("/", " ")]


def canonical_sql(text: str, engine: str, plain: bool = True, spelled: bool = True) -> str:
    """The canonical form as an SQL expression; both engines read the same patterns. plain, spelled: its two halves."""
    flag = "" if engine == "spark" else ", 'g'"
    rules = [(COPYRIGHT_LINE, " "), (r"(\(c\)|©)", " copyright "), (r"[^\p{L}\p{N}]+", " ")] if plain else []
    rules += [(rf"\b{x}\b", y) for x, y in SPELLINGS] if spelled else []
    out = f"lower({text})" if plain else text
    for pattern, to in rules:
        quoted = pattern.replace("\\", "\\\\") if engine == "spark" else pattern
        out = f"regexp_replace({out}, '{quoted}', '{to}'{flag})"
    return f"trim({out})"


def quoted(text: str, engine: str) -> str:
    return "'" + (text.replace("\\", "\\\\").replace("'", "\\'") if engine == "spark" else text.replace("'", "''")) + "'"


def known_sql(engine: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{name}' AS license_id, {quoted(text, engine)} AS t" for name, text in KNOWN)
    whole = ", ".join(f"('{digest}', '{name}')" for name, digests in WHOLE.items() for digest in digests)
    both = f"SELECT md5({canonical_sql('t', engine)}) AS digest, license_id FROM ({rows}) n UNION ALL SELECT digest, license_id FROM (VALUES {whole}) AS w(digest, license_id)"
    return f"SELECT digest, min(license_id) AS license_id FROM ({both}) k GROUP BY 1"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the whole text, the licence that it is (or null), lines that are licences: number and which."""
    spark = docs.sparkSession
    known = F.broadcast(spark.sql(known_sql("spark")))  # one row for each distinct known text
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(HINT))
    # a line that has none of these words is no known text; only the others are normalised
    base = docs.select("doc_id", text.alias("text"), lines.alias("lines"))
    base = base.withColumn("plain", F.expr(canonical_sql("text", "spark", spelled=False)))
    # one pass finds the texts that have another spelling at all; only those are respelled
    other = F.col("plain").rlike(r"\b(?:" + "|".join(x for x, _ in SPELLINGS) + r")\b")
    base = base.withColumn("digest", F.md5(F.when(other, F.expr(canonical_sql("plain", "spark", plain=False))).otherwise(F.col("plain")))).drop("plain")
    base = base.withColumn("line_digests", F.expr(f"transform(lines, t -> md5({canonical_sql('t', 'spark')}))")).drop("text", "lines")
    whole = base.join(known.withColumnRenamed("license_id", "text_license"), "digest", "left")
    table = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("known"))
    out = whole.crossJoin(F.broadcast(table))  # one row: the fixed table as a map
    found = F.filter(F.transform("line_digests", lambda d: F.col("known")[d]), lambda x: x.isNotNull())
    return out.select("doc_id", "digest", "text_license", F.size(found).cast("long").alias("n_license_lines"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("line_licenses"))


def oracle() -> str:
    whole, line = canonical_sql("coalesce(text, '')", "duckdb"), canonical_sql("line", "duckdb")
    return f"""
WITH known AS ({known_sql("duckdb")}),
base AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, md5({whole}) AS digest FROM documents),
lines AS (SELECT rn, md5({line}) AS digest FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM base) x),
hits AS (SELECT rn, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM lines JOIN known USING (digest) GROUP BY rn)
SELECT b.doc_id, b.digest, k.license_id AS text_license, CAST(coalesce(h.n, 0) AS BIGINT) AS n_license_lines, coalesce(h.ids, '') AS line_licenses
FROM base b LEFT JOIN known k ON b.digest = k.digest LEFT JOIN hits h ON b.rn = h.rn
"""
