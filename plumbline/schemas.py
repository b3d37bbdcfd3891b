"""The fixed table layouts (DDL strings) that sources read and sinks write."""

QUESTIONS = """id string, task string, position long, question_type string, question_text string, image_path string,
image_sha256 string, annotated boolean, benchmark_class string, dataset_name string, source_image_id long,
annotation_ids string, expected_answer string, choices string, answer_index long, ablation_of string,
true_weed_count long, true_weed_coverage_fraction double, target_species string, image_width long, image_height long,
boxes string"""

RESPONSES = """id long, run string, model string, question_id string, status string, answer string, reasoning string,
parsed string, raw_response string, warnings string, error_kind string, error_message string, error_http_status long,
attempts long, retry_log string, finish_reason string, latency_seconds double, usage string, total_tokens long,
cost_usd double, generation_id string, provider string, image_sha256 string, prompt_version long, created_at string"""

#: One line of the response log, before it is flattened.
RESPONSE_RECORD = """model string, question_id string, status string, parsed string, reasoning string, raw_response string,
warnings array<string>, error struct<kind: string, message: string, http_status: long>, attempts long,
retry_log array<string>, finish_reason string, latency_seconds double, usage string, cost_usd double,
generation_id string, provider string, image_sha256 string, prompt_version long, created_at string"""

JUDGEMENT = """response_id long, kind string, judge_model string, run string, model string, question_id string,
task string, question_type string, image_path string, match boolean, status string, scores map<string, int>,
notes string, attempts long, latency_seconds double, cost_usd double, judged_at string"""

ANNOTATION_DOCUMENT = """images array<struct<id: long, file_name: string, width: int, height: int, agcontext_id: long, license: long>>,
annotations array<struct<id: long, image_id: long, category_id: long, bbox: array<double>>>,
categories array<struct<id: long, name: string>>"""

#: Judge criteria in the order of the joined columns.
CRITERIA = ("interpretation", "consistency", "knowledge", "visual_evidence", "textual_model", "visual_model")
