"""Column types shared by the operators."""

from pyspark.sql import types as T

USER, ASSISTANT, SYSTEM, FUNCTION, OBSERVATION = "user", "assistant", "system", "function", "observation"

IGNORE = -100  # label value of positions the loss skips

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

# The fixed schema every source is aligned to (besides the key columns the caller keeps).
ALIGNED = T.StructType(
    [
        T.StructField("prompt", MESSAGES),
        T.StructField("response", MESSAGES),
        T.StructField("system", T.StringType()),
        T.StructField("tools", T.StringType()),
    ]
)

LONG_ARRAY = T.ArrayType(T.IntegerType())

# A character that Python's str.strip() would not remove.
NON_BLANK = r"[^\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
