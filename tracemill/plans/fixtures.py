"""Stand-ins for records over the star-schema test tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.sources.records import read_table

VIEWS = {
    "fx_bank": """
SELECT doc_id, lang AS subset, doc_id AS sample_idx, text AS question, CAST(doc_id % 5 AS INT) AS gold,
 concat(source, '-a') AS ch_a, concat(source, '-b') AS ch_b, concat(source, '-c') AS ch_c, concat(source, '-d') AS ch_d,
 CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat(source, '-e') END AS ch_e FROM {documents}""",
    "fx_trace": """
SELECT b.doc_id, b.subset, b.sample_idx + CASE WHEN b.doc_id % 53 = 0 THEN 1000000000 ELSE 0 END AS sample_idx,
 d.text AS reasoning_content, CAST(NULL AS VARCHAR(9)) AS reasoning,
 CASE WHEN b.doc_id % 29 = 0 THEN NULL WHEN coalesce(l.quality, 1) = 1 AND b.doc_id % 11 <> 0 THEN substr('ABCDE', b.gold + 1, 1)
 ELSE substr('ABCDE', (b.gold + 1) % 5 + 1, 1) END AS predicted
 FROM {fx_bank} b JOIN {documents} d ON b.doc_id = d.doc_id LEFT JOIN {labels} l ON b.doc_id = l.doc_id""",
    "fx_cf": """
SELECT doc_id, subset, sample_idx, k,
 CASE WHEN doc_id % 41 = 0 THEN NULL ELSE CAST(5 - (doc_id * 7) % 13 % 5 AS DOUBLE) END AS orig_score,
 CASE WHEN (doc_id + k) % 17 = 0 THEN NULL ELSE CAST(1 + (doc_id * 11 + k * 5) % 19 % 5 AS DOUBLE) END AS cf_score,
 CAST((gold + k) % 5 AS INT) AS target_idx
 FROM {fx_bank} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) kk WHERE doc_id % 23 <> 0""",
    "fx_c2": """
SELECT doc_id, subset, sample_idx, CASE WHEN doc_id % 37 = 0 THEN NULL
 ELSE (1 + (doc_id * 13) % 17 % 5 + 1 + (doc_id * 3) % 11 % 5 + 1 + (doc_id * 19) % 23 % 5) END AS c2_sum FROM {fx_bank}""",
    "fx_eval": """
SELECT a.arm, s.seed, b.subset, b.sample_idx, b.gold, CASE WHEN (b.doc_id + s.seed) % 97 = 0 THEN NULL
 WHEN (b.doc_id * 31 + s.seed * (b.doc_id % 7) * 17 + a.arm_no * (b.doc_id % 3) * 13) % 101 < 62 + a.arm_no THEN b.gold
 ELSE (b.gold + 1) % 5 END AS predicted,
 CASE WHEN (b.doc_id * 7 + s.seed) % 83 = 0 THEN 6000 ELSE 900 END AS output_chars
 FROM {fx_bank} b
 CROSS JOIN (SELECT 'C0' AS arm, 0 AS arm_no UNION ALL SELECT 'C1', 1 UNION ALL SELECT 'C2', 2 UNION ALL SELECT 'C3', 3 UNION ALL SELECT 'C_rand', 4) a
 CROSS JOIN (SELECT 42 AS seed UNION ALL SELECT 43 UNION ALL SELECT 44) s WHERE (b.doc_id + s.seed * a.arm_no) % 61 <> 0""",
    "fx_runs": """
SELECT *, 1 AS pos FROM {fx_eval}
UNION ALL SELECT arm, seed, subset, sample_idx, gold, (gold + 1) % 5 AS predicted, output_chars, 0 AS pos FROM {fx_eval} WHERE sample_idx % 7 = 0
UNION ALL SELECT arm, seed, subset, sample_idx, gold, CASE WHEN sample_idx % 2 = 0 THEN gold ELSE NULL END AS predicted, output_chars, 2 AS pos
 FROM {fx_eval} WHERE sample_idx % 11 = 0""",
    "fx_cot": """
SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN '' ELSE '정답: B' END AS final,
 CASE doc_id % 5 WHEN 0 THEN concat('<think>', text, repeat(' however', CAST(doc_id % 4 AS INT)), '</think> end') WHEN 1 THEN concat('a <THINK> ', text, ' hmm</think> <think>b</think>')
 WHEN 2 THEN text WHEN 3 THEN concat('<think>', repeat('long ', 1700), text, '</think>') ELSE concat('<think>but', text, ' </think>') END AS cot,
 CASE WHEN doc_id % 13 = 0 THEN text ELSE concat('<think>', text, repeat(' wait', CAST(doc_id % 3 AS INT)), ' isn''t right</think>') END AS cf1,
 CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('<think>', repeat('혹시 ', CAST(doc_id % 5 AS INT)), text, '</think>') END AS cf2,
 CASE doc_id % 7 WHEN 0 THEN concat('[Step 1] ', text, ' [Step 2] [Step 3] [Step 4] so, 정답: (C).  ') WHEN 1 THEN concat(text, ' Thus, 정답 : d')
 WHEN 2 THEN concat('[Step 4] yes 4 ', text) WHEN 3 THEN concat(text, ' 답: ', text, ' 답: Yes') WHEN 4 THEN concat('정답: A', text, ' 정답：E ') WHEN 5 THEN text ELSE NULL END AS formed,
 CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, repeat('가나다 ', CAST(length(text) / 4 AS INT))) WHEN 2 THEN repeat('한글 ', 20) ELSE ' 12 ! ' END AS mixed
 FROM {documents}""",
    "fx_answer": """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('답은 B번 ', lower(text), repeat(' pad', 30)) WHEN 1 THEN concat('답은 A 아니고 (C) 입니다 ', lower(text), repeat(' pad', 30))
 WHEN 2 THEN concat('따라서, D ', lower(text), repeat(' pad', 30)) WHEN 3 THEN concat('정답: (A) ', text, ' 정답 : E', repeat(' pad', 30))
 WHEN 4 THEN concat('E 이다 ', lower(text), ' (B) 입니다', repeat(' pad', 30)) WHEN 5 THEN concat(lower(text), ' the choice is (D).') WHEN 6 THEN lower(text) ELSE NULL END AS raw,
 CASE doc_id % 8 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' WHEN 3 THEN 'E' WHEN 4 THEN 'B' WHEN 5 THEN 'D' END AS expected FROM {documents}""",
    "fx_judge": """
SELECT doc_id, k, substr('ABCDE', CAST(doc_id * 3 % 7 % 5 AS INT) + 1, 1) AS ref_letter,
 CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN 'B' ELSE substr('ABCDE', CAST(doc_id * 3 % 7 % 5 AS INT) + 1, 1) END AS cand_letter,
 coalesce(orig_score, 3) AS ref_score, coalesce(cf_score, 2) AS cand_score FROM {fx_cf}""",
    "fx_text": """
SELECT doc_id, CASE doc_id % 8
 WHEN 0 THEN concat('{{"supported_letter": "A", "score": ', CAST(1 + doc_id % 5 AS VARCHAR(9)), ', "reason": "r"}}')
 WHEN 1 THEN concat('noise {{"score": 9}} then {{"score": ', CAST(1 + doc_id % 5 AS VARCHAR(9)), '}}')
 WHEN 2 THEN concat('{{"score": ', CAST(1 + doc_id % 5 AS VARCHAR(9)), ', "reason": "cut') WHEN 3 THEN '' WHEN 4 THEN 'no verdict'
 WHEN 5 THEN concat('{{"justification": ', CAST(1 + doc_id % 3 AS VARCHAR(9)), ', "coherence": 4, "clarity": 5}}')
 WHEN 6 THEN concat('정답: A ', coalesce(text, ''), ' 정답 : (', substr('ABCDE', CAST(doc_id % 5 AS INT) + 1, 1), ') ok') ELSE NULL END AS raw
 FROM {documents}""",
}
NEEDS = {
    "fx_bank": (), "fx_trace": ("fx_bank",), "fx_cf": ("fx_bank",), "fx_c2": ("fx_bank",), "fx_eval": ("fx_bank",),
    "fx_judge": ("fx_cf", "fx_bank"), "fx_text": (), "fx_cot": (), "fx_answer": (),
    "fx_runs": ("fx_bank", "fx_eval"),
}
#: What Spark reads otherwise than DuckDB, whose casts to INT round halves to even, and the same in its words.
SPARK = {"CAST(length(text) / 4 AS INT)": "CAST(bround(length(text) / 4) AS INT)"}


class Tables:
    """The test tables of a folder and the views over them, as lazy plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.base(name)
        text = VIEWS[name]
        names = [n for n in (*VIEWS, "documents", "labels") if f"{{{n}}}" in text]
        for said, meant in SPARK.items():
            text = text.replace(said, meant)
        return self.spark.sql(text, **{n: self[n] for n in names})


def with_views(sql: str, *names: str) -> str:
    """The oracle's form: the views that a query needs as common table expressions before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    plain = {n: n for n in (*VIEWS, "documents", "labels")}
    views = ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in order)
    rest = sql.lstrip()
    for lead in ("WITH RECURSIVE", "WITH"):
        if rest.upper().startswith(lead):
            return f"{lead} {views},\n{rest[len(lead):]}"
    return f"WITH {views}\n{sql}"
