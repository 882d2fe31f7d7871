"""Record layouts as Spark schemas, in the form that readers take."""

from __future__ import annotations

LETTERS = "ABCDE"
SUBSETS = ("doctor", "nurse", "pharm", "dentist")
GATES = ("correctness", "readability", "format_parse", "length")
ARMS = ("C0", "C1", "C2", "C3", "C_rand")


FILTER_RECORD = "struct<filter_name: string, passed: boolean, score: double, reason: string>"
JUDGE_SCORE = "struct<step_coherence: double, korean_fluency: double, step_coverage: double>"
FORMAT_CHECK = (
    "struct<has_step1: boolean, has_step2: boolean, has_step3: boolean, has_step4: boolean, "
    "has_answer_line: boolean, all_steps_present: boolean>"
)
CF_ITEM = (
    "struct<target_idx: int, target_letter: string, cf_cot: string, cf_score: double, judge_runs: array<int>, "
    "regen_model: string, error: string>"
)
HEDGE = (
    "struct<measured_on: string, orig_hedge_rate: double, cf_hedge_min: double, cf_hedge_max: double, "
    "cf_hedge_mean: double, hedge_gap: double, "
    "per_cf: array<struct<target_letter: string, cf_hedge_rate: double, hedge_gap: double>>>"
)
COUNTERFACTUAL = (
    "struct<k: int, orig_target_letter: string, orig_score: double, orig_judge_runs: array<int>, "
    f"counterfactuals: array<{CF_ITEM}>, cf_max: double, gap: double, hedge: {HEDGE}>"
)

QUESTION_BANK = "subset string, sample_idx long, question string, A string, B string, C string, D string, E string, answer int"
RAW_TRACE = (
    "global_idx long, subset string, sample_idx long, question string, model string, predicted string, correct string, "
    f"is_correct boolean, reasoning string, reasoning_content string, format_check {FORMAT_CHECK}, prompt_mode string, "
    "seed int, think_lang string, think_lang_probs map<string, double>, input_tokens long, output_tokens long, error string"
)
RAW_COUNTERFACTUAL = (
    "global_idx long, subset string, sample_idx long, question string, model string, gold_letter string, wrong_letter string, "
    "predicted string, cf_content string, cf_reasoning_content string, think_lang string, think_lang_probs map<string, double>, "
    "input_tokens long, output_tokens long, error string"
)
SCORED_SAMPLE = (
    "id string, subset string, question string, choices array<string>, answer int, teacher_model string, cot string, "
    f"predicted_answer int, filter_history array<{FILTER_RECORD}>, judge_score {JUDGE_SCORE}, "
    f"metadata struct<global_idx: long, sample_idx: long, gold_letter: string, wrong_letter: string, counterfactual: {COUNTERFACTUAL}>"
)
UNIFIED = (
    "id string, subject string, question string, choices array<string>, gold int, think string, final_answer string, tokens long, "
    "en_ratio double, filters struct<C0: boolean, C1: boolean, C2: boolean, C3: boolean, C_rand: boolean>, "
    "signals struct<c1: struct<correctness: boolean, readability: boolean, format_parse: boolean, length: boolean>, "
    "think_lang: string, c2_score: double, gap: double, orig_score: double>"
)
SFT_EXPORT = (
    "messages array<struct<role: string, content: string>>, meta struct<id: string, subject: string, gold: string, answer_used: string>"
)
EVAL_RESULT = "subset string, sample_idx long, gold string, predicted string, is_correct boolean, output string"
EARLY_ANSWER = "subset string, sample_idx long, gold string, frac double, pred string, correct boolean"
JUDGE_COMPARISON = (
    "id string, side string, kind string, supported_letter string, matches_target boolean, score double, n_ok int, n_api_err int, keep boolean"
)
OPEN_ENDED = (
    "question string, gold string, wrong string, orig_score int, cf_score int, gap int, cf_cot string, drop boolean, reason string"
)
