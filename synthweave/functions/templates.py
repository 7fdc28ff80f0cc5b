"""Prompt strings.

Fixed values: these texts must equal the reference's byte for byte, because
generated data, parsers and scores depend on them.  Kept together, in the
order the reference defines them.
"""

# --- fixed values: few-shot generation prompts -----------------------------
ICL_SAMPLE = "###example:\n\n##instruction: \n{instruction} \n##output:\n{output}\n\n"
ICL_HEADER = ("Based on the following examples, please generate a new and unique example that is "
              "different and follows the underlying pattern or theme. Try to make your generation "
              "as diverse as possible.\n\n")
ICL_TAIL = "###example:"

SELF1_SAMPLE = "###example:\n\n##instruction: {instruction}\n"
SELF1_TAIL = "###example:"

SELF2_HEAD = ("Come up with examples for the following tasks. Try to generate multiple examples when "
              "possible. If the task doesn't require additional input, you can generate the output directly.\n")
SELF2_MID = "\n###example:\n\n##instruction: \n"
SELF2_TAIL = "\n##output:"
SELF2_SAMPLE = "###example:\n\n##instruction: \n{instruction}\n##output:\n{output}\n\n"
SELF2_MAX_CHARS = 4096

INSTRUCT_HEAD = ("Below is an instruction that describes a task, paired with an input that provides further "
                 "context. Write a response that appropriately completes the request.\n\n### Instruction:\n")
INSTRUCT_TAIL = "\n\n### Response:\n"

FIN_HEAD = ("Instruction: What is the sentiment of this news? Please choose an answer from "
            "{negative/neutral/positive}\n")
FIN_TAIL = "\nAnswer: "
FIN_NEWS_DELIM = "}."
FIN_MAX_CHARS = 512

MED_HEAD = ("If you are a doctor, please answer the medical questions based on the patient's "
            "description. \n\nPatient: ")
MED_TAIL = "\nChatDoctor: "
MED_SKIP_CHARS = 93

# --- fixed values: training-text templates ---------------------------------
ALPACA_TRAIN = ("Below is an instruction that describes a task. Write a response that appropriately "
                "completes the request.\n\n### Instruction:\n{} \n\n### Response: {}{}")
ALPACA_RESPONSE_MARK = "\n### Response:"
VICUNA_TRAIN = ("A chat between a curious user and an artificial intelligence assistant. The assistant "
                "gives helpful, detailed, and polite answers to the user's questions. USER: {} ASSISTANT: {}{}")
VICUNA_RESPONSE_MARK = " ASSISTANT:"

# --- fixed values: IFD texts -----------------------------------------------
IFD_PROMPT_INPUT = ("Below is an instruction that describes a task, paired with an input that provides "
                    "further context. Write a response that appropriately completes the request.\n\n"
                    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:")
IFD_PROMPT_NO_INPUT = ("Below is an instruction that describes a task. Write a response that appropriately "
                       "completes the request.\n\n### Instruction:\n{instruction}\n\n### Response:")
IFD_RESPONSE = "### Response:"
IFD_WIZ_RESPONSE = "\n\n### Response:"
IFD_WIZ_INPUT = "\nInput:"

# --- fixed values: embedding text ------------------------------------------
EMBED_TEXT = "#instruction:\n{}\n#response:\n{}"

# --- fixed values: generation markers and parse rules ----------------------
MARK_EXAMPLE = "###example:"
MARK_INSTRUCTION = "##instruction:"
MARK_OUTPUT = "##output:"
BAD_OUTPUT_EXAMPLE = ("###example", "### example")
BAD_OUTPUT_INSTRUCTION = ("##instruction", "##Instruction")
SIMILARITY_CUT = 0.52
