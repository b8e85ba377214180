from postpulse.functions.labels import label_numeric, label_prompt, normalise_label
from postpulse.functions.posts import (
    combined_text,
    default_body,
    epoch_to_utc,
    month_epoch,
    month_of,
    strip_entity,
    truncate_body,
)
from postpulse.functions.stats import student_t_pvalue
from postpulse.functions.text import (
    STOPWORDS,
    lower_trim,
    map_pos,
    ngrams,
    normalise_tokens,
    remove_stopwords,
    strip_special,
    tokenise,
)

__all__ = [
    "STOPWORDS",
    "combined_text",
    "default_body",
    "epoch_to_utc",
    "label_numeric",
    "label_prompt",
    "lower_trim",
    "map_pos",
    "month_epoch",
    "month_of",
    "ngrams",
    "normalise_label",
    "normalise_tokens",
    "remove_stopwords",
    "strip_entity",
    "strip_special",
    "student_t_pvalue",
    "tokenise",
    "truncate_body",
]
