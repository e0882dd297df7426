"""From raw responses to per-frame rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as fx
from spanloom.functions.vectors import cosine_distance, l2_normalise
from spanloom.operators import ingest
from spanloom.plans.registry import Registry
from spanloom.plans.views import PART_KEYWORDS, Views, with_views
from spanloom.vocab import RELATION_SIGNATURES

registry = Registry()


def object_payloads(v: Views):
    """One response per frame: plain, fenced, wrapped once or twice, or broken."""
    item = F.struct(F.col("ordinal"), F.col("raw_id").alias("id"),
                    F.when(F.pmod("ordinal", F.lit(11)) == 0, "").otherwise(F.col("class")).alias("class"),
                    F.concat(F.lit("seen "), F.col("class")).alias("description"),
                    F.concat(F.lit("["), F.array_join(F.col("blocks").cast("array<string>"), ", "),
                             F.lit("]")).alias("blocks"))
    lists = v.objects.groupBy("analysis_id", "frame").agg(F.array_sort(F.collect_set(item)).alias("items"))
    texts = F.transform("items", lambda o: F.concat(
        F.lit('{"id": "'), o["id"], F.lit('", "class": "'), o["class"], F.lit('", "description": "'),
        o["description"], F.lit('", "blocks": '),
        F.when(F.pmod(o["ordinal"], F.lit(2)) == 0, o["blocks"]).otherwise(
            F.translate(o["blocks"], "[]", "")), F.lit("}")))
    body = F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))
    kind = F.pmod("frame", F.lit(5))
    response = (F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.")))
                .when(kind == 1, F.concat(F.lit('{"objects": '), body, F.lit("}")))
                .when(kind == 2, F.concat(F.lit('{"result": {"objects": '), body, F.lit("}}")))
                .when(kind == 3, body)
                .otherwise(F.concat(F.lit("[{broken "), body)))
    return lists.select("analysis_id", "frame", response.alias("response"))


_PARSED = """,
    p AS (SELECT analysis_id, frame, row_number() OVER (PARTITION BY analysis_id, frame ORDER BY ordinal)
            - 1 AS ordinal, ordinal AS source, raw_id, class, 'seen ' || class AS description, block
          FROM objects)"""


@registry.query(with_views("objects") + _PARSED + """
    SELECT analysis_id, frame, CAST(ordinal AS INT) AS ordinal, raw_id, class, description,
           CAST(block AS VARCHAR) AS blocks FROM p WHERE frame % 5 <> 4 AND source % 11 <> 0""")
def parse_object_payloads(v: Views):
    objects, _ = ingest.parse_objects(object_payloads(v))
    return objects.withColumn("blocks", F.array_join(F.col("blocks").cast("array<string>"), ","))


@registry.query(with_views("objects") + """
    SELECT analysis_id, frame FROM objects WHERE frame % 5 = 4 GROUP BY analysis_id, frame""")
def rejected_payloads(v: Views):
    _, rejected = ingest.parse_objects(object_payloads(v))
    return rejected.select("analysis_id", "frame")


@registry.query(with_views("observed") + """
    SELECT event_id, unnest(list_distinct([k % 8 + 1, k % 5 + 1, k % 8 + 1])) AS block FROM observed""")
def expand_blocks(v: Views):
    def block(n: int):
        return (F.pmod("k", F.lit(n)) + 1).cast("int")

    return ingest.expand_blocks(v.observed.select(
        "event_id", F.array(block(8), block(5), block(8)).alias("blocks")))


@registry.query(with_views("observed") + """
    SELECT event_id, least((k % 8) % 4, (k % 5) % 4) * 320 AS x1,
      least((k % 8) // 4, (k % 5) // 4) * 360 AS y1,
      greatest((k % 8) % 4, (k % 5) % 4) * 320 + 320 AS x2,
      greatest((k % 8) // 4, (k % 5) // 4) * 360 + 360 AS y2 FROM observed WHERE k % 3 <> 0
    UNION ALL SELECT event_id, 0, 0, 1280, 720 FROM observed WHERE k % 3 = 0""")
def block_boxes(v: Views):
    """Grid of 2 x 4 over 1280 x 720; no blocks means the whole frame."""
    blocks = F.when(F.col("k") % 3 != 0, F.array(
        (F.pmod("k", F.lit(8)) + 1).cast("int"), (F.pmod("k", F.lit(5)) + 1).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    return v.observed.select("event_id", fx.block_box(blocks, 2, 4, F.lit(1280), F.lit(720)).alias("b")
                             ).select("event_id", "b.*")


@registry.query(with_views("frame_rel") + "SELECT * FROM frame_rel WHERE frame % 24 = 0")
def sampled_frames(v: Views):
    return ingest.sample_frames(v.frame_rel, 24)


# Event types spoken of as relations; ``signup`` is outside the vocabulary.
_NAMES = {"click": "running", "view": "carrying", "purchase": "explosion_visible",
          "error": "Physical_Altercation", "signup": "waving"}
_SQL_NAME = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in _NAMES.items()) + " END"


def relation_payloads(v: Views):
    """Per frame one line of ``name(a, b)`` calls in event order, with a none()."""
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    call = F.concat(F.element_at(names, F.col("event_type")), F.lit("("), F.col("user_id").cast("string"),
                    F.lit(", "), F.col("k").cast("string"), F.lit(")"))
    calls = v.observed.groupBy("analysis_id", "frame").agg(
        F.array_sort(F.collect_set(F.struct("event_id", call.alias("c")))).alias("cs"))
    line = F.array_join(F.transform("cs", lambda c: c["c"]), " ")
    return calls.select("analysis_id", "frame", F.concat(line, F.lit(" none()")).alias("response"))


_CALLS = f""", calls AS (SELECT analysis_id, frame, CAST(row_number() OVER (
        PARTITION BY analysis_id, frame ORDER BY event_id) AS INT) AS relation_id,
      lower({_SQL_NAME}) AS relation_type, user_id, k FROM observed)"""


@registry.query(with_views("observed") + _CALLS + """
    SELECT analysis_id, frame, relation_id, relation_type,
      CAST(user_id AS VARCHAR) || '|' || CAST(k AS VARCHAR) AS args FROM calls
    UNION ALL SELECT analysis_id, frame, CAST(count(*) + 1 AS INT), 'none', '' FROM calls GROUP BY 1, 2""")
def parse_relation_text(v: Views):
    rows = ingest.parse_relations(relation_payloads(v))
    return rows.withColumn("args", F.array_join("args", "|"))


def _vocabulary(v: Views):
    return v.literals(list(RELATION_SIGNATURES.items()), "name string, signature string")


@registry.query(with_views("observed") + _CALLS + f"""
    SELECT analysis_id, frame, relation_id, relation_type FROM calls
    WHERE relation_type IN {tuple(RELATION_SIGNATURES)}""")
def known_relations(v: Views):
    rows = ingest.keep_vocabulary(ingest.parse_relations(relation_payloads(v)), _vocabulary(v))
    return rows.drop("args")


@registry.query("""
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'person,vehicle' WHEN 1 THEN 'vehicle,object'
      WHEN 2 THEN 'person' ELSE 'object' END AS allowed FROM part""")
def signature_classes(v: Views):
    signatures = F.array(*[F.lit(s) for s in (
        "(PersonID1, VehicleID?)", " (VehicleID?, Other, ObjectID?)", "(PersonID1, PersonID2)",
        "(Thing, ObjectID)")])
    return v.table("part").select("p_partkey", F.array_join(ingest.allowed_classes(
        F.element_at(signatures, (F.col("p_size") % 4 + 1).cast("int"))), ",").alias("allowed"))


_GATED = _CALLS + """,
    present AS (SELECT DISTINCT analysis_id, frame, user_id AS class_id,
        ['person', 'vehicle', 'object'][CAST(user_id % 3 + 1 AS INT)] AS class FROM observed),
    args AS (SELECT analysis_id, frame, relation_id, relation_type, user_id AS class_id FROM calls
             UNION SELECT analysis_id, frame, relation_id, relation_type, k FROM calls),
    gated AS (SELECT a.analysis_id, a.frame, a.relation_id, a.relation_type, CAST(a.class_id AS INT) AS class_id,
        p.class FROM args a JOIN present p USING (analysis_id, frame, class_id)
        WHERE (relation_type = 'running' AND class = 'person')
           OR (relation_type = 'carrying' AND class IN ('person', 'object'))
           OR (relation_type = 'explosion_visible' AND class IN ('vehicle', 'object'))
           OR (relation_type = 'physical_altercation' AND class = 'person'))"""


def _present(v: Views):
    return v.objects.join(v.observed.select("analysis_id", "frame", F.col("event_id").cast("int").alias("ordinal"),
                                            F.col("user_id").cast("int").alias("class_id")),
                          ["analysis_id", "frame", "ordinal"])


def _gated(v: Views):
    relations = ingest.parse_relations(relation_payloads(v))
    return ingest.gate_participants(relations, _vocabulary(v), _present(v))


@registry.query(with_views("observed") + _GATED + " SELECT * FROM gated")
def gate_participants(v: Views):
    return _gated(v)


@registry.query(with_views("observed") + _GATED + """
    SELECT analysis_id, frame, relation_type, class_id, min(relation_id) AS relation_id FROM gated
    GROUP BY 1, 2, 3, 4""")
def participation_once_per_frame(v: Views):
    return ingest.store_once(_gated(v))


@registry.query(with_views("observed") + _GATED + """
    SELECT DISTINCT analysis_id, frame, relation_type, class_id, relation_id FROM gated""")
def participation_per_relation(v: Views):
    return ingest.store_once(_gated(v), per_relation=True)


# -- label text ------------------------------------------------------------------

def stem_sql(word: str) -> str:
    base = f"trim(lower({word}), '_.,;:!?')"
    cases = " ".join(f"WHEN ends_with({base}, '{s}') AND length({base}) > {len(s) + 2} "
                     f"THEN left({base}, length({base}) - {len(s)})"
                     for s in ("ing", "ed", "ly", "s", "es", "ies", "ness", "tion"))
    return f"(CASE {cases} ELSE {base} END)"


_CLEAN = ("replace(trim(regexp_replace(lower(regexp_replace({t}, '[^a-zA-Z0-9_ ]+', ' ', 'g')), "
          "' +', ' ', 'g')), ' ', '_')")
_KEYWORDS_SQL = "(VALUES " + ", ".join(
    f"('{k}', '{c}', {i})" for i, (c, k) in enumerate(
        (c, k) for c, ks in PART_KEYWORDS.items() for k in ks)) + ") t(keyword, class, ordinal)"
_SYN = f"""syn AS (SELECT keyword, max_by(class, o) AS class FROM (
      SELECT keyword, class, ordinal * 2 AS o FROM {_KEYWORDS_SQL}
      UNION ALL SELECT {stem_sql('keyword')}, class, ordinal * 2 + 1 FROM {_KEYWORDS_SQL}) GROUP BY keyword)"""
# Labels vary per part: decorated, plural, or reduced to a single character.
_LABEL_SQL = """CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN '**' || upper(p_name) || 's!'
    WHEN 2 THEN 'a ' || p_name || '-like, thing' WHEN 3 THEN replace(p_name, ' ', '_') ELSE left(p_name, 1) END"""


def _labels(v: Views):
    name, kind = F.col("p_name"), F.col("p_size") % 5
    label = (F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("**"), F.upper(name), F.lit("s!")))
             .when(kind == 2, F.concat(F.lit("a "), name, F.lit("-like, thing")))
             .when(kind == 3, F.replace(name, F.lit(" "), F.lit("_"))).otherwise(F.left(name, F.lit(1))))
    return v.table("part").select("p_partkey", label.alias("label"))


@registry.query(f"""WITH {_SYN},
    l AS (SELECT p_partkey, {_LABEL_SQL} AS label FROM part),
    c AS (SELECT p_partkey, label, {_CLEAN.format(t='label')} AS cleaned FROM l),
    k AS (SELECT p_partkey, unnest(list_filter(string_split(cleaned, '_'), lambda x: length(x) >= 2)) AS token,
            generate_subscripts(list_filter(string_split(cleaned, '_'), lambda x: length(x) >= 2), 1) AS pos FROM c),
    h AS (SELECT k.p_partkey, coalesce(a.class, b.class) AS class, pos FROM k
          LEFT JOIN syn a ON a.keyword = k.token LEFT JOIN syn b ON b.keyword = {stem_sql('k.token')}),
    f AS (SELECT p_partkey, min_by(class, pos) AS class FROM h WHERE class IS NOT NULL GROUP BY 1)
    SELECT c.p_partkey, c.label, coalesce(a.class, b.class, f.class,
        CASE WHEN c.p_partkey NOT IN (SELECT p_partkey FROM k) THEN c.cleaned END) AS class
    FROM c LEFT JOIN syn a ON a.keyword = c.cleaned LEFT JOIN syn b ON b.keyword = {stem_sql('c.cleaned')}
    LEFT JOIN f ON f.p_partkey = c.p_partkey""")
def normalise_labels(v: Views):
    synonyms = ingest.synonym_table(v.synonyms_source)
    return ingest.normalise_labels(_labels(v), synonyms, "label", "class")


@registry.query(f"""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS keyword,
      p_type AS class, p_partkey AS ordinal FROM part)
    SELECT keyword, max_by(class, o) AS class FROM (
      SELECT keyword, class, ordinal * 2 AS o FROM w
      UNION ALL SELECT {stem_sql("keyword")}, class, ordinal * 2 + 1 FROM w) GROUP BY keyword""")
def synonym_table(v: Views):
    words = v.table("part").select(
        F.explode(F.split("p_name", " ")).alias("keyword"), F.col("p_type").alias("class"),
        F.col("p_partkey").alias("ordinal"))
    return ingest.synonym_table(words)


_WORDS = "lower(p_name) || CASE p_size % 4 WHEN 0 THEN 'ing' WHEN 1 THEN 's,' WHEN 2 THEN 'ness' ELSE '_tion' END"


@registry.query(f"""SELECT p_partkey, {_WORDS} AS word, {stem_sql(_WORDS)} AS stemmed,
    {_CLEAN.format(t=_WORDS)} AS cleaned, replace(lower(trim(' ' || p_type || ' X ')), ' ', '_') AS canonical
    FROM part""")
def label_text(v: Views):
    ending = F.element_at(F.array(*[F.lit(s) for s in ("ing", "s,", "ness", "_tion")]),
                          (F.col("p_size") % 4 + 1).cast("int"))
    word = F.concat(F.lower("p_name"), ending)
    return v.table("part").select(
        "p_partkey", word.alias("word"), fx.stem(word).alias("stemmed"),
        fx.clean_label(word).alias("cleaned"),
        fx.canonical_class(F.concat(F.lit(" "), "p_type", F.lit(" X "))).alias("canonical"))


@registry.query(with_views("objects") + """
    SELECT analysis_id, frame, ordinal, 'ID ' || ordinal || ', Class ' || class || ', ' || raw_id
      || ', Blocks [' || block || '], Frame ' || frame AS document, '[' || block || ']' AS blocks_json
    FROM objects""")
def object_documents(v: Views):
    return v.objects.select(
        "analysis_id", "frame", "ordinal",
        fx.object_document(F.col("ordinal"), F.col("class"), F.col("raw_id"), F.col("blocks"),
                           F.col("frame")).alias("document"),
        F.to_json("blocks").alias("blocks_json"))


@registry.query(with_views("objects") + """
    SELECT analysis_id, frame, ordinal, CAST(block AS VARCHAR) AS blocks FROM objects""")
def blocks_json_round_trip(v: Views):
    back = F.from_json(F.to_json("blocks"), "array<int>")
    return v.objects.select("analysis_id", "frame", "ordinal",
                            F.array_join(back.cast("array<string>"), ",").alias("blocks"))


@registry.query("""
    WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings),
      n AS (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-6)) AS u FROM d)
    SELECT a.vec_id, round(list_sum(a.u), 6) AS component_sum, round(sqrt(list_dot_product(a.u, a.u)), 6) AS norm,
      round(1 - list_dot_product(a.u, b.u), 6) AS distance_to_next
    FROM n a JOIN n b ON b.vec_id = a.vec_id + 1""")
def vector_functions(v: Views):
    unit = v.table("embeddings").select(
        "vec_id", l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("u"))
    following = unit.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w"))
    total = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(F.transform("u", lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))
    return unit.join(following, "vec_id").select(
        "vec_id", F.round(total, 6).alias("component_sum"), F.round(norm, 6).alias("norm"),
        F.round(cosine_distance(F.col("u"), F.col("w")), 6).alias("distance_to_next"))
