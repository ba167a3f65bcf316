"""Prompts, word lists, patterns and limits that decide results.

They are stated as they must be for results to agree; nothing in this module is
logic.  Everything that reads them lives in ``functions`` and ``operators``.
"""

# ---- prompts -----------------------------------------------------------------
GENERATOR_SYSTEM = "Please reason step by step, and put your final answer within \\boxed{...}."

TAGGED_VERIFIER_SYSTEM = (
    "You are an exacting math verifier. Given the question and the generator's last message, output these tags strictly: \n"
    "<verdict>correct|incorrect</verdict>\n"
    "<feedback>short, actionable critique; if incorrect, point to the precise mistake</feedback>\n"
    "<fixed_answer>if you can, provide the corrected final answer inside \\boxed{...}; otherwise empty</fixed_answer>"
)
TAGGED_QUESTION_LABEL = "Question: "
TAGGED_ANSWER_LABEL = "\n---\nGenerator message:\n"

JUDGED_VERIFIER_SYSTEM = "You are the verifier model."
JUDGED_VERIFY_INSTRUCTION = (
    "Check the generator's math solution step-by-step. "
    "If you find a mistake: state the wrong step and explain why it's wrong. "
    "If all steps are correct, explain why. "
    "Provide the reasoning and the final judgement of the correctness. "
    "Include explanation in the final response (not only inside <think>). "
    "The last word of your response must be either 'correct' or 'incorrect'."
)
JUDGED_UNFINISHED_NOTE = (
    "\n\nNote: The generator's response contains an unfinished <think> block "
    "(missing </think>). Treat this as incorrect, but still review the reasoning "
    "and mention any other errors you find."
)
JUDGED_REGENERATE_INSTRUCTION = (
    "The verifier indicated that your previous answer was wrong. Provide the correct solution now. "
    "Keep reasoning concise, and put the final answer at the end in \\boxed{...}."
)
QUESTION_LABEL = "\n\nQuestion:\n"
PREVIOUS_ANSWER_LABEL = "\n\nPrevious answer:\n"
VERIFIER_FEEDBACK_LABEL = "\n\nVerifier feedback:\n"

# ---- delimiters and patterns --------------------------------------------------
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
BOXED_FIRST_PATTERN = r"\\boxed\{([^\}]+)\}"
FIXED_ANSWER_TAG = "fixed_answer"
VERDICT_TAG = "verdict"
FEEDBACK_TAG = "feedback"

# ---- word lists ----------------------------------------------------------------
VERDICT_CORRECT = "correct"
VERDICT_INCORRECT = "incorrect"
VERDICT_WRONG = "wrong"
USER_ROLES = ("user", "human", "student", "questioner", "qa.user", "customer", "client")
ROLE_KEYS = ("role", "from", "speaker", "name")
CONTENT_KEYS = ("content", "text", "value", "message", "prompt")
SINGLE_QUESTION_KEYS = ("content", "question", "prompt", "input")
GROUND_TRUTH_KEYS = ("ground_truth", "answer", "solution", "label", "gt")

# The 29 characters Python's str.strip() removes.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ---- numbers -------------------------------------------------------------------
ROLLOUT_HISTORY_LIMIT = 12
TRAINING_HISTORY_LIMIT = 9
DEFAULT_MAX_TURNS = 4
SNIPPET_LENGTH = 120
SNIPPET_KEEP = 117
SNIPPET_ELLIPSIS = "..."
TOKEN_BUDGET_FLOOR = 256
TOKEN_BUDGET_MARGIN = 32
REWARD_THRESHOLD = 0.5
TEACHER_STATUS = "revise"
TEACHER_JUSTIFICATION = ""

# What a missing or zero sampling parameter stands for when requests are grouped.
SAMPLING_DEFAULTS = {
    "temperature": 0.0,
    "top_p": 1.0,
    "top_k": 0,
    "min_p": 0.0,
    "max_tokens": 0,
    "repetition_penalty": 1.0,
    "presence_penalty": 0.0,
    "frequency_penalty": 0.0,
}
