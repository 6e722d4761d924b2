"""Kinds of follow-up turns, how far they reach back, their weights, and which pairs make sense."""

INTENTS = {
    "reformat": 12, "lexical_constraint": 14, "restyle": 8, "compress": 8, "expand": 5, "genre_convert": 8,
    "fact_recall": 12, "fact_update": 9, "chained_compute": 8, "self_critique": 6, "deepen": 5, "open_chat": 5,
}
POLICIES = {"immediate": 30, "cumulative": 25, "standing": 20, "delayed_recall": 25}
CATEGORIES = {
    "explore": ("deepen", "expand", "chained_compute", "self_critique", "open_chat"),
    "transform": ("reformat", "lexical_constraint", "restyle", "compress", "genre_convert"),
    "memory": ("fact_recall", "fact_update"),
}
SCOPES = {"immediate": "current_turn", "cumulative": "cumulative", "standing": "standing", "delayed_recall": "delayed_recall"}
INVALID = (
    ("fact_recall", "cumulative"), ("fact_recall", "standing"), ("fact_update", "cumulative"), ("fact_update", "standing"), ("chained_compute", "standing"),
    ("open_chat", "cumulative"), ("open_chat", "standing"), ("open_chat", "delayed_recall"), ("deepen", "cumulative"), ("deepen", "standing"), ("deepen", "delayed_recall"),
)
SENSITIVE = ("deepen", "expand", "compress", "open_chat", "self_critique")
RATIOS = {"explore": 0.5, "transform": 0.3, "memory": 0.2}
MOST_TRANSFORM = 0.5
