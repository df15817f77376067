"""Questions to SQL in bulk, as DataFrame jobs."""

from .operators.execute import execute_batch, execute_query, result_rows
from .operators.model import GENERATION, REVIEW, ModelSettings
from .plans.ask import Answer, answer_batch, answer_questions, ask, open_dump
from .plans.generate import run_batch, schema_of_databases
from .sources.dumps import scan_dump
from .sources.questions import scan_question_lines, scan_questions
from .streaming.predict import read_question_stream, stream_predictions

__all__ = [
    "GENERATION",
    "REVIEW",
    "Answer",
    "ModelSettings",
    "answer_batch",
    "answer_questions",
    "ask",
    "execute_batch",
    "execute_query",
    "open_dump",
    "read_question_stream",
    "result_rows",
    "run_batch",
    "scan_dump",
    "scan_question_lines",
    "scan_questions",
    "schema_of_databases",
    "stream_predictions",
]
