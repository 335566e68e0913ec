"""License scans, in DataFrame operations only.

Statements of a file are its lines, its blocks (runs of non-blank lines), its header (the
comment that it begins with) and, if its name is that of a licence file, its whole text; comment marks don't
count. Statements are compared with license templates by the cosine of sparse TF-IDF
vectors, term by term through a join on the term; document frequencies count all
files. A file takes the license of its best statement. Licence files
also speak for their directory: a file without a license inherits that of its nearest
ancestor directory (its own first), by joining the beginnings of its path.

Only statements that can reach the threshold are compared. For a cosine c, the terms that a
statement shares with a template hold c^2 of the template's squared weights at least. So of
each template the heaviest terms are listed until the others hold less, and a
statement without any of them can't reach it: an exact bound, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
#: License names with one-line notices, headers and short licenses in full.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License."),
    ("MIT", _MIT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GPL_END + " If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + _GPL_END),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License."),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_THIRD} {_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
]
THRESHOLD = 0.6
#: Rows that a broadcast may carry: some 20 MB of terms and numbers.
BROADCAST_ROWS = 200_000
#: What a comment's line begins and ends with, the names of licence files, and a term.
MARK = "^[ \\t]*(?:/[*]+|[*]+/|[*]+|//+|#+|--+|;+|<!--|%+)"
TRAIL = "[ \\t]*(?:[*]+/|-->)?[ \\t\\r]*$"
LICENSE_FILE = "(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying|notice)(?:[._-][^/]*)?$"
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tf() -> Column:
    """Of the rows of a term: logarithmic, so that frequent function words don't outweigh rare words."""
    return 1.0 + F.log(F.count("*"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def statements(text: Column, path: Column) -> Column:
    """The distinct statements of a file as an array of strings."""
    raw = F.split(text, "\n")
    plain = F.transform(raw, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, MARK, ""), TRAIL, ""), "\t", " ")))
    blocks = F.transform(F.split(F.array_join(plain, "\n"), "\n\n+"), lambda x: F.trim(F.translate(x, "\n", " ")))
    first_plain = F.array_position(F.transform(raw, lambda x: x.rlike(MARK)), False)
    header = F.array_join(F.when(first_plain == 0, plain).otherwise(F.slice(plain, 1, F.greatest(first_plain - 1, F.lit(0)).cast("int"))), " ")
    whole = F.when(path.rlike(LICENSE_FILE), F.array_join(plain, " ")).otherwise("")
    return F.array_distinct(F.filter(F.concat(plain, blocks, F.array(F.trim(header), F.trim(whole))), lambda x: x != ""))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scan(files: DataFrame, templates: DataFrame, id_col: str, repo_col: str, path_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """id, repo, path, license, score, origin (own, inherited or none), origin_dir: one row per row of files.

    templates: license, notice; no templates give no licenses. tf = 1 + ln(occurrences), idf = ln((1 + N) / (1 + df)) + 1 over all N files and
    templates, df of them with the term. Of equal scores the first license by name wins.
    Null texts have no statements; a null path counts as a file in the root, a
    null repo as "". Copies, ties and repeated rows each get a row, lines of any length are compared. A directory
    with licence files of several licenses takes the best score's, then the first by
    name. An empty table gives an empty one; other columns are ignored.
    """
    base = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(repo_col), F.lit("")).alias("repo"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    notices = templates.select("license", "notice").filter("license IS NOT NULL AND notice IS NOT NULL").distinct()
    # Weights of terms, from all files.
    counted = base.select(F.col("text")).unionByName(notices.select(F.col("notice").alias("text"))).select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = base.count() + notices.count()
    idf = stored(counted.select("term", (F.log((1.0 + F.lit(total)) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "license-idf")
    listed = notices.select("license", "notice", F.explode(terms(F.col("notice"))).alias("term")).groupBy("license", "notice", "term").agg(_tf().alias("tf"))
    against = stored(listed.join(idf, "term").select("license", "notice", "term", (F.col("tf") * F.col("idf")).alias("y")).coalesce(1), "license-templates")
    own, square = Window.partitionBy("license", "notice"), F.col("y") * F.col("y")
    rest = F.sum(square).over(own.orderBy(F.desc("y"), "term").rowsBetween(0, Window.unboundedFollowing))
    heavy = against.select("term", (rest >= F.sum(square).over(own) * (threshold * threshold * (1 - 1e-9))).alias("h")).filter("h").select("term").distinct()
    heavy = [r["term"] for r in heavy.collect()]  # some of the templates' terms
    may = lambda text: F.arrays_overlap(terms(text), F.array(*map(F.lit, heavy)).cast("array<string>"))
    rows = base.filter(may(F.col("text"))).select("id", "repo", "path", F.explode(F.filter(statements(F.col("text"), F.col("path")), may)).alias("statement"))
    rows = stored(rows.select("id", "repo", "path", "statement", F.sha2("statement", 256).alias("s")), "license-statements")
    # Each distinct statement once against all templates.
    said = rows.groupBy("s").agg(F.min("statement").alias("statement")).select("s", F.explode(terms(F.col("statement"))).alias("term")).groupBy("s", "term").agg(_tf().alias("tf"))
    said = stored(said, "license-terms")
    weighed = said.join(_small(stored(idf.join(_small(said.select("term").distinct()), "term", "left_semi"), "license-known")), "term").select("s", "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = weighed.groupBy("s").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    size = against.groupBy("license", "notice").agg(F.sqrt(F.sum(square)).alias("ny"))
    dot = weighed.join(_small(against), "term").groupBy("s", "license", "notice").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dot.join(_small(size), ["license", "notice"]).join(norm, "s").select("s", "license", F.round(F.col("dot") / (F.col("nx") * F.col("ny")), 6).alias("score")).filter(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("score"), "license"))
    matched = stored(scored.groupBy("s").agg(best.alias("b")).select("s", "b.license", (-F.col("b.score")).alias("score")), "license-matches")
    found = rows.select("id", "repo", "path", "s").join(_small(matched), "s").groupBy("id", "repo", "path").agg(best.alias("b"))
    found = stored(found.select("id", "repo", "path", "b.license", (-F.col("b.score")).alias("score")), "license-own")
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    governed = found.filter(F.col("path").rlike(LICENSE_FILE)).select("repo", folder.alias("dir"), "license", "score").groupBy("repo", "dir").agg(best.alias("b"))
    governed = stored(governed.select("repo", "dir", F.col("b.license").alias("dir_license"), (-F.col("b.score")).alias("dir_score")), "license-dirs")
    # Ancestors are sought once per distinct directory.
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.when(k > 0, F.array_join(F.slice(parts, 1, k), "/")).otherwise("").alias("dir")))
    places = base.select("repo", folder.alias("folder"), above.alias("above")).distinct()
    reached = places.select("repo", "folder", F.explode("above").alias("a")).select("repo", "folder", "a.depth", "a.dir").join(_small(governed), ["repo", "dir"])
    nearest = stored(reached.groupBy("repo", "folder").agg(F.max(F.struct("depth", "dir", "dir_license", "dir_score")).alias("g")), "license-nearest")
    slim = base.select("id", "repo", "path").withColumn("folder", folder)
    found = _small(found.select(F.col("id").alias("i"), F.col("repo").alias("r"), F.col("path").alias("p"), "license", "score"))
    joined = slim.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("repo") == F.col("r")) & (F.col("path") == F.col("p")), "left")
    joined = joined.join(_small(nearest), ["repo", "folder"], "left")
    return joined.select(
        "id",
        "repo",
        "path",
        F.coalesce("license", "g.dir_license").alias("license"),
        F.coalesce("score", "g.dir_score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("folder")).otherwise(F.col("g.dir")).alias("origin_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """repo and path for the documents table, which has none: a ternary tree of directories, 40 slots a repository.

    slot = doc_id div 20; the repository is source/r(slot div 40), the place in its tree slot % 40. Every third
    document is a licence file by its name.
    """
    slot = F.floor(F.col("doc_id") / 20)
    k = F.pmod(slot, F.lit(40))
    up = lambda x: F.floor((x - 1) / 3)
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    tree = F.when(k == 0, F.lit("")).when(k <= 3, F.concat(name(k), F.lit("/"))).when(k <= 12, F.concat_ws("/", name(up(k)), name(k), F.lit(""))).otherwise(F.concat_ws("/", name(up(up(k))), name(up(k)), name(k), F.lit("")))
    return docs.withColumn("repo", F.concat(F.col("source"), F.lit("/r"), F.floor(slot / 40).cast("string"))).withColumn("path", F.concat(tree, F.when(F.col("doc_id") % 3 == 1, "LICENSE-").otherwise("f"), F.col("doc_id").cast("string")))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_paths(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    templates = spark.createDataFrame(TEMPLATES, "license string, notice string")
    found = scan(docs, templates, "doc_id", "repo", "path", "text")
    return found.select(F.col("id").alias("doc_id"), "repo", "path", "license", F.round("score", 3).alias("score"), "origin", "origin_dir")


_VALUES = ", ".join("('{}', '{}')".format(name, notice.replace("'", "''")) for name, notice in TEMPLATES)
_TERMS = f"regexp_extract_all(translate({{}}, '{_UPPER}', '{_LOWER}'), '{TERM}')"
#: All statements are compared here, without the bound.
ORACLE_SQL = f"""
WITH t(license, notice) AS (VALUES {_VALUES}),
base AS (
  SELECT doc_id, coalesce(text, '') AS text, slot % 40 AS k, coalesce(source || '/r' || (slot // 40), '') AS repo FROM (SELECT doc_id, text, source, doc_id // 20 AS slot FROM documents)),
placed AS (
  SELECT doc_id, text, repo,
         coalesce(CASE WHEN k = 0 THEN '' WHEN k <= 3 THEN 'p' || k || '/' WHEN k <= 12 THEN 'p' || ((k - 1) // 3) || '/p' || k || '/'
              ELSE 'p' || (((k - 1) // 3 - 1) // 3) || '/p' || ((k - 1) // 3) || '/p' || k || '/' END || CASE WHEN doc_id % 3 = 1 THEN 'LICENSE-' ELSE 'f' END || doc_id, '') AS path FROM base),
f AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS folder, regexp_matches(path, '{LICENSE_FILE}') AS legal FROM placed),
cut AS (SELECT *, list_transform(string_split(text, chr(10)), lambda x: trim(replace(regexp_replace(regexp_replace(x, '{MARK}', ''), '{TRAIL}', ''), chr(9), ' '), ' ')) AS plain,
        list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '{MARK}')), false) AS upto FROM f),
lines AS (SELECT DISTINCT doc_id, repo, path, folder, legal, statement FROM (SELECT doc_id, repo, path, folder, legal, unnest(list_concat(plain,
          list_transform(regexp_split_to_array(array_to_string(plain, chr(10)), chr(10) || chr(10) || '+'), lambda x: trim(replace(x, chr(10), ' '), ' ')),
          [trim(array_to_string(CASE WHEN coalesce(upto, 0) = 0 THEN plain ELSE plain[: upto - 1] END, ' '), ' '), CASE WHEN legal THEN trim(array_to_string(plain, ' '), ' ') ELSE '' END])) AS statement FROM cut) WHERE statement <> ''),
n AS (SELECT (SELECT count(*) FROM f) + (SELECT count(*) FROM t) AS n),
idf AS (SELECT term, ln((1.0 + (SELECT n FROM n))::DOUBLE / (1.0 + count(*))::DOUBLE) + 1 AS idf
        FROM (SELECT unnest(list_distinct({_TERMS.format("text")})) AS term FROM f UNION ALL SELECT unnest(list_distinct({_TERMS.format("notice")})) FROM t) GROUP BY term),
st AS (SELECT statement, term, 1 + ln(count(*)) AS tf FROM (SELECT statement, unnest({_TERMS.format("statement")}) AS term FROM (SELECT DISTINCT statement FROM lines)) GROUP BY ALL),
tt AS (SELECT license, notice, term, 1 + ln(count(*)) AS tf FROM (SELECT license, notice, unnest({_TERMS.format("notice")}) AS term FROM t) GROUP BY ALL),
w AS (SELECT statement, term, tf * idf AS x FROM st JOIN idf USING (term)),
v AS (SELECT license, notice, term, tf * idf AS y FROM tt JOIN idf USING (term)),
nw AS (SELECT statement, sqrt(sum(x * x)) AS nx FROM w GROUP BY 1), nv AS (SELECT license, notice, sqrt(sum(y * y)) AS ny FROM v GROUP BY ALL),
dot AS (SELECT statement, license, notice, sum(x * y) AS d FROM w JOIN v USING (term) GROUP BY ALL),
sc AS (SELECT statement, license, round(d / (nx * ny), 6) AS score FROM dot JOIN nw USING (statement) JOIN nv USING (license, notice)),
m AS (SELECT statement, license, score FROM sc WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY statement ORDER BY score DESC, license) = 1),
own AS (SELECT doc_id, repo, path, folder, legal, license, score FROM lines JOIN m USING (statement) QUALIFY row_number() OVER (PARTITION BY doc_id, repo, path ORDER BY score DESC, license) = 1),
gov AS (SELECT repo, folder AS dir, license, score FROM own WHERE legal QUALIFY row_number() OVER (PARTITION BY repo, folder ORDER BY score DESC, license) = 1),
near AS (SELECT fo.repo, fo.folder, g.dir, g.license, g.score
         FROM (SELECT DISTINCT repo, folder FROM f) fo JOIN gov g ON fo.repo = g.repo AND (g.dir = '' OR g.dir = fo.folder OR starts_with(fo.folder, g.dir || '/'))
         QUALIFY row_number() OVER (PARTITION BY fo.repo, fo.folder ORDER BY length(g.dir) DESC) = 1)
SELECT f.doc_id, f.repo, f.path, coalesce(o.license, n.license) AS license, round(coalesce(o.score, n.score), 3) AS score,
       CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN o.license IS NOT NULL THEN f.folder ELSE n.dir END AS origin_dir
FROM f LEFT JOIN own o ON f.doc_id IS NOT DISTINCT FROM o.doc_id AND f.repo = o.repo AND f.path = o.path LEFT JOIN near n ON f.repo = n.repo AND f.folder = n.folder
"""
