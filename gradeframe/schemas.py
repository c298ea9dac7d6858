"""Schemas and defaults of the stored tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql.types import StructType

_DDL = {
    "exam_papers": "id long, paper_id string, course_code string, course_name string, "
    "exam_name string, total_marks double, duration_hours double, exam_date string, "
    "batch string, programme string, semester string, set_name string, raw_text string, "
    "parsed_at timestamp",
    "exam_parts": "paper_id_fk long, part_name string, marks_per_question double, "
    "num_questions int, instructions string",
    "exam_questions": "id long, paper_id_fk long, question_number int, question_text string, "
    "marks double, part_name string, question_type string, is_or_option boolean, "
    "teacher_answer string, correct_option string, created_at timestamp",
    "students": "id long, student_code string, name string, created_at timestamp",
    "questions": "id long, exam_name string, question_text string, teacher_answer string, "
    "correct_option string, mcq_options map<string,string>, max_marks double",
    "rubrics": "id long, question_id long, exam_question_id long, criterion string, "
    "marks double, is_required boolean",
    "submissions": "id long, student_id long, question_id long, exam_paper_id long, "
    "exam_question_id long, image_path string, extracted_text string, ocr_confidence double, "
    "submitted_at timestamp",
    "results": "submission_id long, question_type string, final_score double, max_marks double, "
    "confidence double, evaluation_time_sec double, llm_score double, similarity_score double, "
    "feedback string, strengths array<string>, missing_concepts array<string>, "
    "mcq_correct boolean, mcq_detected_answer string, mcq_correct_answer string",
    "metrics_snapshots": "id int, open_ended string, mcq string, total_evaluated long, "
    "computed_at timestamp",
    "student_booklets": "booklet_id long, student_id long, exam_paper_id long, total_pages int, "
    "roll_number string, register_number string, set_name string, course_code string, "
    "course_name string, exam_name string, programme string, semester string, "
    "date_of_exam string, raw_full_ocr string, parsed_at timestamp",
    "student_answer_texts": "id long, booklet_id long, exam_question_id long, "
    "question_number int, part_name string, is_or_option boolean, answer_text string, "
    "raw_ocr_text string, submission_id long, evaluated boolean",
}
TABLES = sorted(_DDL)


@lru_cache(maxsize=None)
def schema_of(table: str) -> StructType:
    """Schema of a stored table; needs an active session."""
    return StructType.fromDDL(_DDL[table])



DEFAULTS: dict[str, dict[str, object]] = {
    "exam_papers": {"total_marks": 0.0, "duration_hours": 2.0},
    "exam_parts": {"marks_per_question": 2.0, "num_questions": 0},
    "exam_questions": {"marks": 2.0, "question_type": "open_ended", "is_or_option": False},
    "students": {"name": ""},
    "questions": {"max_marks": 10.0},
    "rubrics": {"marks": 1.0, "is_required": False},
    "results": {
        "max_marks": 10.0, "llm_score": 0.0, "similarity_score": 0.0, "question_type": "open_ended",
    },
    "student_answer_texts": {"is_or_option": False, "evaluated": False},
}
