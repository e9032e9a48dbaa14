"""Registered queries of the changes, gates and further scalars, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import scalars as S
from claimloom.operators import conflicts, facts as K, gates, mutations
from claimloom.plans.queries import ALIASES, FILE, _aliases
from claimloom.plans.registry import query
from claimloom.plans.triples import ENGINE_SQL, FACTS, SINGLE_VALUED, facts, table

#: What the orders' state rules on their claims: finished ones are accepted, pending ones rejected.
DECISIONS = "decisions AS (SELECT 'order:' || o_orderkey AS subject, 'placed_by' AS relation, 'customer:' || o_custkey AS object, o_orderstatus = 'F' AS accept FROM orders WHERE o_orderstatus IN ('F','P'))"


def _decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'P')")
    return o.select(F.concat(F.lit("order:"), "o_orderkey").alias("subject"), F.lit("placed_by").alias("relation"), F.concat(F.lit("customer:"), "o_custkey").alias("object"), (F.col("o_orderstatus") == "F").alias("accept"))


@query(f"""WITH {FACTS}, {DECISIONS} SELECT f.subject, f.relation, f.object, f.source, CASE WHEN status IN ('needs_review','candidate') AND accept THEN 'accepted' WHEN status IN ('needs_review','candidate') AND NOT accept THEN 'superseded' ELSE status END AS status
  FROM facts f LEFT JOIN decisions d ON f.subject = d.subject AND f.relation = d.relation AND f.object = d.object""")
def M2_accept_and_reject(spark, sf_dir):
    return mutations.decide(facts(spark, sf_dir), _decisions(spark, sf_dir)).select(*K.TRIPLE, "source", "status")


@query(f"""WITH {FACTS}, a AS (SELECT 'part:' || p_partkey AS subject, 'has_size' AS relation, CAST(p_size AS VARCHAR) AS object, CAST(p_size + 100 AS VARCHAR) AS new_object FROM part WHERE p_size > 40),
  m AS (SELECT f.*, new_object FROM facts f LEFT JOIN a USING (subject, relation, object))
  SELECT subject, relation, object, source, CASE WHEN new_object IS NOT NULL THEN 'superseded' ELSE status END AS status FROM m
  UNION ALL SELECT subject, relation, new_object, source, 'accepted' FROM m WHERE new_object IS NOT NULL AND status <> 'superseded'""")
def M3_amended_objects(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 40")
    amendments = p.select(F.concat(F.lit("part:"), "p_partkey").alias("subject"), F.lit("has_size").alias("relation"), F.col("p_size").cast("string").alias("object"), (F.col("p_size") + 100).cast("string").alias("new_object"))
    return mutations.amend(facts(spark, sf_dir), amendments).select(*K.TRIPLE, "source", "status")


WITHDRAWN = "withdrawn AS (SELECT 'sources/supplier_' || s_suppkey || '.md' AS file FROM supplier WHERE s_acctbal < 0)"


def _withdrawn(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("sources/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("file"))


@query(f"WITH {FACTS}, {WITHDRAWN} SELECT relation, CASE WHEN {FILE} IN (SELECT file FROM withdrawn) THEN 'superseded' ELSE status END AS status, count(*) AS n, count(DISTINCT subject) AS n_subjects FROM facts GROUP BY ALL")
def M4_ejected_sources(spark, sf_dir):
    return mutations.eject(facts(spark, sf_dir), _withdrawn(spark, sf_dir)).groupBy("relation", "status").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_subjects"))


@query(f"WITH {ENGINE_SQL}, {WITHDRAWN} SELECT subject, relation, object FROM engine GROUP BY ALL HAVING bool_and({FILE} IN (SELECT file FROM withdrawn))")
def M4_last_copies(spark, sf_dir):
    return mutations.last_copies(facts(spark, sf_dir), _withdrawn(spark, sf_dir))


@query("SELECT c_custkey, c_name, coalesce('SEG ' || s.seg, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS seg FROM orders GROUP BY 1) s ON c_custkey = o_custkey")
def M12_refreshed_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    upstream = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("SEG "), F.min("o_orderpriority")).alias("c_mktsegment")).withColumn("c_name", F.lit("never taken"))
    return mutations.refresh(c, upstream, "c_custkey", ("c_mktsegment",))


@query("SELECT DISTINCT o_custkey AS id, CASE WHEN c_custkey IS NULL THEN 'no-ledger' WHEN c_acctbal < 0 THEN 'written' ELSE 'unchanged' END AS outcome FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def M10_acknowledged(spark, sf_dir):
    ledger = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("withdrawn"))
    return mutations.acknowledge(ledger, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id", "withdrawn")


# gates

@query(f"WITH {ENGINE_SQL} SELECT relation, count(*) AS n_subjects FROM (SELECT subject, relation FROM engine WHERE relation IN {'(' + ','.join(repr(x) for x in SINGLE_VALUED) + ')'} GROUP BY ALL HAVING count(DISTINCT object) > 1) GROUP BY 1")
def G1_conflict_gate(spark, sf_dir):
    return conflicts.conflicts(facts(spark, sf_dir), SINGLE_VALUED).groupBy("relation").agg(F.count("*").alias("n_subjects"))


@query("SELECT DISTINCT 'object' AS column, text AS value FROM conversations WHERE turn % 2 = 0 AND regexp_matches(text, '[\\x00-\\x1F]')".replace("AS column", 'AS "column"'))
def G2_control_characters(spark, sf_dir):
    """What every conversation says, as claims, of which those with an even turn are accepted."""
    c = table(spark, sf_dir, "conversations")
    said = c.select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("subject"), F.lit("says").alias("relation"), F.coalesce("text", F.lit("")).alias("object"), F.when(F.col("turn") % 2 == 0, "accepted").otherwise("candidate").alias("status"))
    return gates.control_characters(said)


WRITTEN = "written AS (SELECT subject, relation, object FROM facts WHERE status = 'confirmed' OR (status = 'superseded' AND relation = 'has_size'))"


def _written(spark, sf_dir):
    return facts(spark, sf_dir).where("status = 'confirmed' OR (status = 'superseded' AND relation = 'has_size')").select(*K.TRIPLE)


def _by_part(spark, sf_dir):
    """The engine claims of sales with a relation of its own for each part and state."""
    sold = K.engine_facts(facts(spark, sf_dir)).where("relation = 'sold_as'")
    return sold.withColumn("relation", F.concat_ws("_", "relation", "object", F.substring_index("subject", ":", -1)))


BY_PART = ENGINE_SQL + ", parts AS (SELECT subject, 'sold_as_' || object || '_' || split_part(subject, ':', 2) AS relation, object, source, status, confidence FROM engine WHERE relation = 'sold_as')"


@query(f"WITH {BY_PART} SELECT DISTINCT relation FROM parts WHERE relation NOT IN (SELECT relation FROM parts WHERE confidence >= '0.50')")
def G3_relation_gap(spark, sf_dir):
    """Relations of which only claims of little confidence are in the table, and so none was written."""
    rows = _by_part(spark, sf_dir)
    return gates.relation_gap(rows, K.atoms(rows.where("confidence >= '0.50'")))


@query(f"""WITH {ENGINE_SQL}, {WRITTEN}, a AS (SELECT subject, relation, object FROM engine EXCEPT SELECT * FROM written), b AS (SELECT * FROM written EXCEPT SELECT subject, relation, object FROM engine)
  SELECT *, 'only-table' AS side FROM a UNION ALL SELECT *, 'only-written' FROM b""")
def G4_drift(spark, sf_dir):
    return gates.drift(facts(spark, sf_dir), _written(spark, sf_dir))


@query(f"""WITH {FACTS}, s AS (SELECT CASE right(confidence, 1) WHEN '7' THEN upper(status) WHEN '8' THEN NULL WHEN '9' THEN status || relation ELSE status END AS status FROM facts)
  SELECT status, count(*) AS n FROM s WHERE status IS NULL OR status NOT IN ('confirmed','accepted','needs_review','candidate','superseded') GROUP BY 1""")
def G5_unknown_statuses(spark, sf_dir):
    digit = F.right("confidence", F.lit(1))
    odd = F.when(digit == "7", F.upper("status")).when(digit == "8", F.lit(None)).when(digit == "9", F.concat("status", "relation")).otherwise(F.col("status"))
    return gates.unknown_statuses(facts(spark, sf_dir).withColumn("status", odd))


@query(f"WITH {ENGINE_SQL} SELECT DISTINCT relation, object FROM engine WHERE relation IN ('has_size', 'has_priority')")
def G6_untyped_literals(spark, sf_dir):
    """Sizes are no ordinals and priorities no numbers; days and totals parse."""
    return gates.untyped(facts(spark, sf_dir), {"has_size": "ordinal", "has_priority": "number", "ordered_on": "date", "has_total": "number"})


@query(f"""WITH {ENGINE_SQL}, d AS (SELECT 'in_nation' AS relation, 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation UNION ALL SELECT 'sold_in', n_name, 'x' FROM nation UNION ALL SELECT 'in_nation', 'region:' || r_regionkey, 'region:' || (r_regionkey + 1) % 5 FROM region)
  SELECT relation, child, parent, CASE WHEN child LIKE 'region:%' THEN 'cycle' WHEN relation = 'sold_in' THEN 'unused-relation' ELSE 'unused-value' END AS warning FROM d
  WHERE child LIKE 'region:%' OR relation = 'sold_in' OR child NOT IN (SELECT object FROM engine WHERE relation = 'in_nation')""")
def G7_hierarchy_warnings(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    declared = n.select(F.lit("in_nation").alias("relation"), F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("region:"), "n_regionkey").alias("parent"))
    declared = declared.union(n.select(F.lit("sold_in"), "n_name", F.lit("x"))).union(r.select(F.lit("in_nation"), F.concat(F.lit("region:"), "r_regionkey"), F.concat(F.lit("region:"), ((F.col("r_regionkey") + 1) % 5).cast("string"))))
    return gates.hierarchy_warnings(facts(spark, sf_dir), declared)


@query(f"""WITH {ENGINE_SQL}, {WITHDRAWN}, q AS (SELECT DISTINCT l_suppkey AS question, 'part:' || l_partkey AS subject, l_returnflag || l_linestatus AS object FROM lineitem WHERE l_shipdate IS NOT NULL),
  was AS (SELECT DISTINCT subject, object FROM engine WHERE relation = 'sold_as'),
  now AS (SELECT DISTINCT e.subject, e.object FROM engine e ANTI JOIN withdrawn w ON split_part(e.source, '#', 1) = w.file WHERE relation = 'sold_as')
  SELECT question, q.subject, q.object FROM q SEMI JOIN was USING (subject, object) ANTI JOIN now USING (subject, object)""")
def G9_drop_impact(spark, sf_dir):
    """Questions whether a part was sold in a state; withdrawing suppliers' files leaves some without an answer."""
    rows = facts(spark, sf_dir)
    sold = table(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL").select(F.col("l_suppkey").alias("question"), F.concat(F.lit("part:"), "l_partkey").alias("subject"), F.concat("l_returnflag", "l_linestatus").alias("object")).distinct()
    asked = sold.withColumn("relation", F.lit("sold_as"))
    return gates.drop_impact(asked, rows, mutations.eject(rows, _withdrawn(spark, sf_dir), purge=True), by=K.TRIPLE).drop("relation")


@query("""SELECT l_suppkey AS id, 'duplicate' AS fault FROM lineitem GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT l_suppkey, 'value' FROM lineitem WHERE l_returnflag NOT IN ('A','N') OR l_returnflag IS NULL""")
def G11_ledger_faults(spark, sf_dir):
    return gates.ledger_faults(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), "l_returnflag"), "id", "l_returnflag", ("A", "N"))


# set operations and counts over relations

@query(f"WITH {FACTS}, {ALIASES} SELECT DISTINCT coalesce(canonical, relation) AS relation FROM facts LEFT JOIN aliases ON relation = raw WHERE status IN ('confirmed','accepted')")
def A32_supported_relations(spark, sf_dir):
    return K.canonical(K.engine_facts(facts(spark, sf_dir)), _aliases(spark)).select("relation").distinct()


@query(f"WITH {FACTS}, {ALIASES} SELECT relation FROM facts UNION SELECT raw FROM aliases UNION SELECT canonical FROM aliases")
def A33_relation_vocabulary(spark, sf_dir):
    aliases = _aliases(spark)
    return facts(spark, sf_dir).select("relation").union(aliases.select("raw")).union(aliases.select("canonical")).distinct()


@query(f"WITH {BY_PART}, {WITHDRAWN} SELECT relation FROM parts WHERE {FILE} IN (SELECT file FROM withdrawn) EXCEPT SELECT relation FROM parts WHERE {FILE} NOT IN (SELECT file FROM withdrawn)")
def A31_lost_relations(spark, sf_dir):
    rows = _by_part(spark, sf_dir).withColumn("file", S.source_file(F.col("source")))
    gone = _withdrawn(spark, sf_dir)
    return gates.lost_relations(rows.join(gone, "file", "left_anti"), rows.join(gone, "file", "left_semi"), _aliases(spark))


@query(f"WITH {ENGINE_SQL} SELECT r_regionkey AS region, count(*) AS n FROM engine JOIN region ON object = 'region:' || r_regionkey OR object IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = r_regionkey) WHERE relation IN ('in_nation', 'in_region') GROUP BY 1")
def A36_matches_of_a_pattern(spark, sf_dir):
    """How many claims match ``located_in`` with each region as object, through aliases and descendants."""
    n = table(spark, sf_dir, "nation")
    below = n.select(F.lit("in_nation").alias("relation"), F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("region:"), "n_regionkey").alias("ancestor"), "n_regionkey")
    counts = None
    for region in [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()]:
        found = K.matching(K.engine_facts(facts(spark, sf_dir)), relation="located_in", aliases=_aliases(spark))
        one = K.matching(found, obj=f"region:{region}", hierarchy=below).groupBy(F.lit(region).alias("region")).agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query(f"WITH {ENGINE_SQL}, {ALIASES}, c AS (SELECT DISTINCT subject, canonical, object FROM engine JOIN aliases ON relation = raw) SELECT DISTINCT c.subject, c.object AS customer, n.object AS place FROM c JOIN c n ON c.object = n.subject WHERE c.canonical = 'ordered_by' AND n.canonical = 'located_in'")
def J6_canonical_body(spark, sf_dir):
    rows = K.canonical(K.atoms(facts(spark, sf_dir)), _aliases(spark)).distinct()
    orders = rows.where("relation = 'ordered_by'").select("subject", F.col("object").alias("customer"))
    return orders.join(rows.where("relation = 'located_in'").select(F.col("subject").alias("customer"), F.col("object").alias("place")), "customer").select("subject", "customer", "place").distinct()


@query(f"WITH {FACTS}, {WITHDRAWN} SELECT {FILE} AS file, count(*) AS n_facts FROM facts WHERE {FILE} IN (SELECT file FROM withdrawn) GROUP BY 1")
def J17_orphaned_sources(spark, sf_dir):
    return K.per_source(facts(spark, sf_dir)).join(_withdrawn(spark, sf_dir), "file", "left_semi").select("file", "n_facts")


@query(f"WITH {ENGINE_SQL}, r AS (SELECT subject, relation, row_number() OVER (PARTITION BY subject ORDER BY relation) AS n FROM (SELECT DISTINCT subject, relation FROM engine)) SELECT subject, string_agg(relation, ',' ORDER BY relation) AS relations FROM r WHERE n <= 6 GROUP BY 1")
def T9_relations_of_a_subject(spark, sf_dir):
    return K.engine_facts(facts(spark, sf_dir)).groupBy("subject").agg(F.array_join(F.slice(F.array_sort(F.collect_set("relation")), 1, 6), ",").alias("relations"))


@query(f"WITH {ENGINE_SQL} SELECT relation, CASE WHEN count(DISTINCT subject) > 1 AND count(DISTINCT object) = 1 THEN 'subject' WHEN count(DISTINCT object) > 1 AND count(DISTINCT subject) = 1 THEN 'object' ELSE 'both' END AS varies FROM engine GROUP BY 1")
def T8_varying_column(spark, sf_dir):
    s, o = F.countDistinct("subject"), F.countDistinct("object")
    kind = F.when((s > 1) & (o == 1), "subject").when((o > 1) & (s == 1), "object").otherwise("both")
    return K.engine_facts(facts(spark, sf_dir)).groupBy("relation").agg(kind.alias("varies"))


@query(f"WITH {ENGINE_SQL}, p AS (SELECT DISTINCT subject, 'large' AS reason FROM engine WHERE relation = 'has_size' AND CAST(object AS BIGINT) >= 40 UNION SELECT subject, 'returned' FROM engine WHERE relation = 'sold_as' AND object LIKE 'R%') SELECT subject, reason FROM p")
def U3_rules_of_one_head(spark, sf_dir):
    rows = K.engine_facts(facts(spark, sf_dir))
    large = rows.where((F.col("relation") == "has_size") & (S.parse_number_scaled(F.col("object")) >= 40_000)).select("subject", F.lit("large").alias("reason"))
    return large.unionByName(rows.where((F.col("relation") == "sold_as") & F.col("object").startswith("R")).select("subject", F.lit("returned").alias("reason"))).distinct()


@query("""WITH r AS (SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS k FROM conversations), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) AS n FROM r) SELECT conv_id, turn, role FROM b WHERE n = 1""")
def W5_best_of_each(spark, sf_dir):
    rank = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    return K.first_by(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [rank, "turn"])


# scalars, each with literals that do not parse

@query("SELECT doc_id, strip_accents(lower(text)) AS plain FROM documents")
def X13_without_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.strip_accents(F.lower("text")).alias("plain"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS pmid, CASE WHEN c_nationkey < 20 THEN '10.1234/c.' || c_custkey END AS doi FROM customer")
def X45_labelled_ids(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    pmid = F.concat(F.when(F.col("c_acctbal") < 0, "XPMID ").otherwise("see pmid: "), key, F.lit(" there"))
    doi = F.concat(F.lit("note\n"), F.when(F.col("c_nationkey") < 20, "DOI: https://doi.org/10.1234/C.").otherwise("the doi: 10.1234/C."), key, F.lit("\nend"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.labelled_pmid(pmid).alias("pmid"), S.labelled_doi(doi).alias("doi"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL WHEN p_size < 20 THEN 20240000 + 101 WHEN p_size < 30 THEN p_size * 1000 WHEN p_size < 40 THEN p_size ELSE p_size * 10000 END AS scalar FROM part""")
def X65_scalar_by_type(spark, sf_dir):
    size = F.col("p_size")
    kind = F.when(size < 10, "colour").when(size < 20, "date").when(size < 30, "number").when(size < 40, "ordinal").otherwise("amount")
    text = F.when(size < 20, F.lit("2024.1")).when(size < 30, size.cast("string")).when(size < 40, F.concat(F.lit("제"), size.cast("string"), F.lit("호"))).otherwise(F.concat(size.cast("string"), F.lit("만원")))
    return table(spark, sf_dir, "part").select("p_partkey", S.scalar(kind, text).alias("scalar"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def X69_iso_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("1997-13-"), F.date_format("o_orderdate", "dd"))).when(F.col("o_orderstatus") == "F", day).otherwise(F.concat(day, F.lit("T10:00:00Z")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.iso_date(text).cast("string").alias("day"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || ',' || p_partkey || CASE WHEN p_size > 25 THEN ',7' ELSE '' END AS version FROM part")
def X73_versions(spark, sf_dir):
    text = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, ".7rc9-1").otherwise(".x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(S.version(text), lambda x: x.cast("string")), ",").alias("version"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '[\\t\\r\\n\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g'), ' ') AS line FROM conversations")
def X33_one_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.one_line(F.col("text")).alias("line"))


@query("SELECT p_partkey, regexp_replace(p_name || ' & ' || p_brand, '[^A-Za-z0-9_:-]', '', 'g') AS key FROM part")
def X35_cite_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.cite_key(F.concat("p_name", F.lit(" & "), "p_brand")).alias("key"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS folded, len(regexp_extract_all(translate(CAST(c_custkey AS VARCHAR), '02468', '     '), '[1]')) > 0 AS foreign_one FROM customer")
def X9_digits_of_any_script(spark, sf_dir):
    text = F.translate(F.col("c_custkey").cast("string"), "0123456789", "0١2३4५6٧8９")
    return table(spark, sf_dir, "customer").select("c_custkey", S.fold_digits(text).alias("folded"), F.array_contains(S.other_digits(text), "١").alias("foreign_one"))


@query("SELECT p_partkey, p_size <= 25 AS complete FROM part")
def X81_complete_index(spark, sf_dir):
    index = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(2)), F.lit("b"), F.when(F.col("p_size") <= 25, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(4))))
    return table(spark, sf_dir, "part").select("p_partkey", S.index_is_complete(index).alias("complete"))


#: Ways to write an author ({g} given, {f} family name), with what the family name is then: {f} its letters.
_AUTHORS = [("{g} {f}", "{f}"), ("{f}, {g}", "{f}"), ("{g} van der {f}", "vander{f}"), ("Van Der {f}, {g}", "vander{f}"), ("{f}", "{f}"), ("Et al.", ""), ("", ""), ("de {f}", "{f}"), (" {g}  x  de. La {f} ", "dela{f}"), ("{g} Ünal-{f}", "unal{f}"), ("{g} van", "van"), ("others", ""), ("{g} 7", "")]


@query(f"""WITH p AS (SELECT p_partkey, lower(p_type) AS f, p_partkey % {len(_AUTHORS)} AS k FROM part) SELECT p_partkey, replace(list_extract({[want for _, want in _AUTHORS]}, CAST(k + 1 AS INTEGER)), '{{f}}', f) AS surname FROM p""")
def X17_surnames(spark, sf_dir):
    form = F.element_at(F.array(*[F.lit(x) for x, _ in _AUTHORS]), (F.col("p_partkey") % len(_AUTHORS) + 1).cast("int"))
    made = F.replace(F.replace(form, F.lit("{f}"), F.col("p_type")), F.lit("{g}"), F.substring_index("p_name", " ", 1))
    return table(spark, sf_dir, "part").select("p_partkey", S.surname(made).alias("surname"))


#: Literals and how people write them; {n} is the size.
_LITERALS = [("date(2030)", "2030"), ("Date( 2030 , 1 )", "2030-01"), ("date(2030,1,5)", "2030-01-05"), ("date(2030,13)", "date(2030,13)"), ('amount({n},"억")', "{n}억"), ("amount(1,{n}00 , km per h)", "1,{n}00km per h"), ("number({n}.5)", "{n}.5"), ('number("-{n}")', "-{n}"), ("ordinal({n})", "ordinal({n})"), ("{n} things", "{n} things")]


@query(f"""SELECT p_partkey, replace(list_extract({[want for _, want in _LITERALS]}, CAST(p_partkey % {len(_LITERALS)} + 1 AS INTEGER)), '{{n}}', CAST(p_size AS VARCHAR)) AS shown FROM part""")
def X49_humanized(spark, sf_dir):
    form = F.element_at(F.array(*[F.lit(x) for x, _ in _LITERALS]), (F.col("p_partkey") % len(_LITERALS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.humanize(F.replace(form, F.lit("{n}"), F.col("p_size").cast("string"))).alias("shown"))


_WORKS = ["W{k}", "w{k}", "https://openalex.org/W{k}", " https://openalex.org/works/w{k}/ ", "W0{k}", "{k}", "W{k}x", "https://example.org/W{k}"]


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(_WORKS)} < 4 AND o_orderkey > 0 THEN 'W' || o_orderkey END AS work FROM orders")
def X40_work_ids(spark, sf_dir):
    form = F.element_at(F.array(*[F.lit(x) for x in _WORKS]), (F.col("o_orderkey") % len(_WORKS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.work_id(F.replace(form, F.lit("{k}"), F.col("o_orderkey").cast("string"))).alias("work"))
