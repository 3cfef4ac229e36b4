"""Explicit schemas of the engine's datasets, as DDL strings."""

from __future__ import annotations

SERIES_FILE = (
    "sample_id string, original_data struct<time_series: array<double>>, "
    "windows array<struct<question: string, answer: string, question_type: string, window_range: struct<start: int, `end`: int>, has_anomaly: boolean>>"
)
RECORD = (
    "record_id string, series_file string, series_index int, window_index int, sample_id string, time_series array<double>, question string, answer string, "
    "question_type string, start_index int, end_index int, has_anomaly boolean"
)
PREDICTION = f"{RECORD}, mode string, response string, loss double"
SCORE = (
    "record_id string, mode string, question_type string, dimension string, weight double, score double, method string, raw_score int, distribution map<string,double>, "
    "fallback_scores array<int>, judge_content string, prompt_sha256 string, model string, provider string, system_fingerprint string, usage string, judge_max_tokens int, "
    "endpoint_host string, logprobs_requested boolean, logprobs_returned boolean, enable_thinking boolean, prompt_template string, scoring_mode string, "
    "missing_score_mass_upper_bound double, score_error_upper_bound double, top_logprobs_cutoff double, distribution_is_truncated boolean, "
    "observed_score_tokens array<string>, missing_score_tokens array<string>, requested_model string, seed int, top_logprobs int"
)
RESPONSE = (
    "choices array<struct<message: struct<content: string>, logprobs: struct<content: array<struct<token: string, logprob: double, "
    "top_logprobs: array<struct<token: string, logprob: double>>>>>>>, model string, system_fingerprint string"
)
JOURNAL = f"dimension string, spec string, prompt string, `row` struct<{PREDICTION}>, primary struct<{RESPONSE}>"
SUBSET = "subset string, record_count int, record_ids array<string>, series_files array<string>"
SPLIT = "seed int, train_ratio double, train_series array<string>, val_series array<string>"
