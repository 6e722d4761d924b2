"""Wordings and patterns that decide a result, as regular expressions in natural order.

All are read without regard to case unless said otherwise, and use only syntax
that the JVM and RE2 read alike.
"""

REFUSAL = [
    r"\bi can'?t (?:help|assist|do that|comply)\b",
    r"\bi'?m (?:sorry,? )?(?:but )?i (?:can'?t|cannot)\b",
    r"\bi am unable to\b",
    r"\bas an ai language model\b",
    r"\bi cannot (?:help|assist|provide)\b",
]
RECALL_REFUSAL = [
    r"\b(?:i (?:can'?t|cannot|don'?t|do not) (?:access|recall|remember|retain|store)|i (?:have no|don'?t have) (?:access|memory|record)|as an ai|i'?m (?:sorry|unable))\b",
]
MEMORY_DISCLAIMER = [
    r"\bi (?:can'?t|cannot|don'?t|do not|am not able to|won'?t) (?:store|retain|remember|recall|keep|save|hold on to|access) [^.?!\n]*(?:between|across|from) (?:[^.?!\n]*?)(?:conversations?|sessions?|chats?|interactions?)",
    r"\bi (?:don'?t|do not) (?:have|retain|keep) (?:any )?memory of (?:our )?(?:previous|past|earlier|prior) (?:conversations?|sessions?|chats?|messages?|turns?)",
    r"\beach (?:conversation|session|chat) is (?:independent|separate|isolated)\b",
    r"\bi (?:have no|don'?t have a) memory (?:of|between|across)\b",
    r"\bi (?:start|begin) (?:each|every) (?:conversation|session|chat) (?:fresh|anew|from scratch)\b",
    r"\bas an ai,? i (?:can'?t|cannot|don'?t|do not) (?:store|retain|remember|recall) [^.?!\n]*(?:information|details|data)\b",
    r"\bi (?:can'?t|cannot|don'?t|do not) remember (?:anything|information|details) (?:from|between|across) (?:previous|past|earlier|prior|separate) ",
]
COT_LEAK = [
    r"</?think\s*>",
    r"\bdraft\s*\d+\b",
    r"\blet'?s (?:verify|double-check|check)\b",
    r"\bself-?contained\??\b",
    r"\bno reference to (?:the )?reasoning\b",
    r"\bfinal answer self-contained\b",
    r"\bscratchpad\b",
    r"\bchain[- ]of[- ]thought\b",
]
SPEC_LEAK = [r"json_valid|top_type|forbidden_token|constraint_spec|standing instruction"]
HARNESS = [
    r"provided\s+good\s+response",
    r"matches?\s+the\s+(?:provided|detailed|good|suggested)",
    r"similar\s+to\s+the\s+provided",
    r"(?:response|answer)\s+provided\s+(?:previously|earlier|above)",
    r"suggested\s+(?:response|answer)\b",
    r"here'?s\s+(?:a|the|my)\s+thinking\s+process",
    r"final\s+output\s+generation",
    r"\bas\s+per\s+(?:the\s+)?system\b",
    r"\bsystem\s+(?:prompt|instructions?|message)\b",
    r"\bmy\s+(?:system\s+)?(?:prompt|instructions?)\b",
    r"continue\s+to\s+honor\s+each\s+of\s+these",
    r"(?:the\s+)?history\s+provided\b",
    r"persistent memory",
    r"you are a (?:helpful |expert |strong |warm |knowledgeable |memory-enabled )*assistant",
    r"drawing on the (?:whole|entire) conversation",
    r"the (?:whole |entire )?conversation above",
    r"write only the final answer",
    r"never deny having memory",
    r"make each inferential step explicit",
    r"\bas an ai\b",
    r"safe\s+completion",
    r"\bdisallowed\b",
    r"\bopenai\b",
    r"\bcontent\s+polic(?:y|ies)\b",
    r"\b(?:safety|content|community|usage|company)\s+guidelines?\b",
    r"\b(?:follow|comply\s+with|adhere\s+to|per|according\s+to|respect|violat\w+)\s+(?:the\s+|our\s+|these\s+|my\s+)?guidelines?\b",
    r"\bmust\s+(?:follow|comply with|adhere to|respect)\s+(?:the\s+|our\s+|this\s+)?polic",
    r"\bpolic(?:y|ies)\s+(?:for|on|regarding|around|about)\s+(?:self-?harm|suicide|violence|self-?injury|crisis|sensitive)",
    r"\btone\s*\**\s*:\s*\**\s*(?:warm|knowledgeable|expert|helpful|friendly|professional|conversational|casual|empathetic|formal|gentle|supportive|encouraging|compassionate|reassuring|enthusiastic|playful|sympathetic|respectful)",
    r"\b(?:warm|knowledgeable|expert|helpful|friendly|professional|conversational|casual|empathetic|formal|gentle|supportive|encouraging|compassionate|reassuring|enthusiastic|playful|sympathetic|respectful)\s+tone\s*:",
    r"(?:^|\n)\s*\**\s*(?:persona|target audience|format|structure)\s*\**\s*:",
    r"\bthinking process\s*:",
    r"contradictory\s+(?:\w+\s+){0,3}system\s+(?:prompt|instructions?)",
    r"warm,?\s+(?:deeply\s+)?knowledgeable expert",
    r"caring counsell?or",
    r"subject-matter(?:\s+expert)?\s+and caring",
    r"write\s+the\s+user'?s?\s+(?:next\s+)?(?:message|reply|turn)",
    r"\bthe\s+user'?s?\s+next\s+(?:message|reply|turn)\b",
    r"\bproduce\s+(?:a|the)\s+user\s+(?:message|reply)\b",
    r"simulate\s+what\s+the\s+user\s+would\s+say",
]
TURN_INDEX_STRICT = r"\bTurn\s+\d+\b|\breference_turn_\d+\b"  # case counts
TURN_INDEX_CUE = r"\b(?:in|from|during|at|see|per|back in|back to|discussed in|mentioned in|as (?:we|you) (?:discussed|said|noted|mentioned) in)\s+turn\s+\d+\b"
FLOW_LINE = r"^\s*(?:\d+\.\s*|[-*]\s*|turn\s+\d+\s*[:.\-]\s*)?\**\s*(?:user|model|assistant)\**\s*[:\-]"  # per line
RESTART = r"(?:^|\n|\.)\s*(?:wait|hold on|actually|okay,? so|let me reconsider|on second thought)\b"  # per line
RESTARTS_FAIL = 6
ARTIFACT_KNOWN = r"\.(?:cw|cltr|clt|cwt|ctr)\b\s*$|(?:\bcw|\bcltr)\s*$"  # case counts
ARTIFACT_TAIL = r"[A-Za-z]{3,}\.([a-z]{1,4})\s*$"  # case counts
ARTIFACT_ALLOWED = "com org net io ai co gov edu py js ts md txt csv json html htm xml yaml yml pdf png jpg jpeg gif svg sh go rs rb cpp etc".split()
ARTIFACT_JUNK = "cw|cltr|clt|cwt|ctr|ot"
CLOSING_PHRASES = (
    r"(?i)(?:\s*(?:"
    r"(?:will\s+|now\s+|let'?s\s+|i'?ll\s+|then\s+)*(?:produce|write|give|output|provide|craft|deliver)\s+(?:the\s+)?(?:final\s+)?(?:answer|response|output|reply)\b[^.\n]*\.?"
    r"|let'?s\s+(?:comply|proceed|do\s+it|go|begin|start|answer|write)\b[^.\n]*\.?"
    r"|proceed\.?"
    r"|time\s+to\s+(?:answer|write|respond|produce)\b[^.\n]*\.?"
    r"|now\s+(?:answer|respond|write\s+it)\b[^.\n]*\.?"
    r"|ok(?:ay)?,?\s+(?:let'?s\s+)?(?:proceed|go|comply|do\s+it)\.?"
    r")\s*)+$"
)
EMPTY_REASONING = ("", ".", "..", "...", "…")
PROMPT_ECHO = [
    r"write the user'?s? next message",
    r"output only the user'?s? message",
    r"your request to the assistant this turn",
    r"make it a coherent continuation",
    r"full conversation so far",
    r"do not answer your own question",
    r"(?:^|\n)\s*-\s*persona\s*:",
    r"(?:^|\n)\s*-\s*length\s*:",
]
BACK_REFERENCE = r"\b(?:earlier|before|you (?:said|mentioned|noted|wrote)|previously|that point|you brought up|going back)\b"
MORE_STOPWORDS = "this that these those it its as be".split()
PERSONAS = ("curious", "skeptical", "frustrated", "enthusiastic", "terse-expert", "casual")
VERBOSITIES = ("short", "medium", "long")
FILLER_TAIL = [
    r"\bwill produce (?:the )?final answer\.?",
    r"\blet'?s comply\.?",
    r"\b(?:proceed|let'?s proceed|let'?s do it|let'?s go)\.\s*$",
    r"\bnow (?:write|produce|output) (?:the )?(?:answer|response)\.?\s*$",
]
FORMAT_MECHANICS = [
    r"\bexactly (?:one|two|three|four|five|\d+) (?:bullet|sentence|word|line|item|paragraph)",
    r"\b(?:not|no) more than\b|\bat most \d+\b",
    r"\bmust be (?:valid )?(?:json|yaml|markdown)\b",
    r"\bno (?:special )?formatting (?:requested|needed)\b",
    r"\bbullet[- ]?point",
    r"\bmarkdown (?:heading|table|format)",
    r"\bensure (?:exactly|not more|the format|it'?s valid)",
    r"\bword count\b|\bcount words\b",
]
STANDING_LICENCE = r"\b(?:from now on|going forward|always|every (?:reply|time|response|answer)|for the rest|keep (?:doing|using)|continue to|each time|whenever I)\b"
NEGATION = r"\b(?:cannot|can'?t|won'?t|will not|don'?t|do not|does not|doesn'?t|not|never|without|avoid\w*|refus\w*|shouldn'?t|rather than|no need to|instead of)\b"
NEGATION_REACH = 30
UNCERTAINTY = [
    r"\bnot sure (?:who|what|whether|exactly|of the|about the)\b",
    r"\b(?:don'?t|do not|can'?t|cannot|couldn'?t) (?:know who|verify|recall|confirm|be sure)\b",
    r"\bnot 100% sure\b|\bnot entirely sure\b|\bI'?m guessing\b",
]
ADMISSION = [
    r"\bfabricat\w*",
    r"\b(?:I'?ll|we (?:can|could|'?ll)|let'?s) invent\w*",
    r"\bmade it up\b|\bmake (?:it|them|one) up\b|\bmade[- ]up (?:source|figure|stat|quote|example)",
    r"\bplausible (?:excerpt|source|sounding|figure|statistic|details?)\b",
    r"\bhypothetical (?:source|citation|quote|excerpt|figure|statistic|study|reference)\b",
    r"\bconstructed (?:illustration|scenario|example)\b|\bconstructed (?:it|this) (?:as|to be )?illustrat",
    r"\b(?:don'?t|do not|doesn'?t) (?:have|exist)\b[^.\n]{0,40}\b(?:public|available|verifiable|record|source)",
    r"\bwe (?:can|'?ll) reference\b",
    r"\bmight have (?:appeared|existed|been (?:at|in))\b",
    r"\bon the spot\b",
    r"\bdoesn'?t turn up\b|\bno (?:publicly available|reliable|verifiable) (?:record|source|info)",
]
SPECIFICS = {
    "url": r"https?://\S+",
    "metacritic_score": r"\bMetacritic\b|\b\d{2,3}\s*/\s*100\b|\b\d{2}\s*/\s*100\b",
    "funding_sum": r"[\$£€]\s?\d[\d,\.]*\s*(?:k|K|M|m|bn|thousand|million|billion)\b|\bKickstarter\b|\bcrowdfund|\braised\s+[\$£€]\s?\d|\bfunding of\b",
    "code_host": r"\bGitHub\b|\bGitLab\b|\b\d[\d,\.]*\s*stars?\b",
    "talk_timestamp": r"\bGDC\b|GodotCon|\bkeynote at\b|(?:\bat|@|around|timestamp|min(?:ute)?\s+mark)\s+\d{1,2}:\d{2}\b|\b\d{1,2}:\d{2}\s*(?:[-–—]\s*\d{1,2}:\d{2}\s*)?(?:min\b|minute|mark\b)",
    "attendance": r"[≈~]?\s?\d[\d,\.]*\s*(?:million|M|k|thousand)?\s*(?:visitors|attendees|tourists|spectators|/\s?yr\b|per year|annually|people a year)\b",
    "poll_pct": r"\b\d{1,3}\s?%[^.\n]{0,30}(?:poll|survey|approval|respondents|voted)",
    "named_citation": r"\b(?:according to|cited in|as reported by|per)\b[^.\n]{0,40}\b(?:report|study|article|interview|blog|podcast)\b",
    "rank_assertion": r"\bthe\s+\d+(?:st|nd|rd|th)[‑\-\s](?:largest|biggest|smallest|most\s+populous|tallest|longest|highest)\b",
}
UNGROUNDED_PREMISE = r"\b\d+(?:st|nd|rd|th)\s+(?:largest|biggest|smallest|most\s+populous|tallest|longest|highest|richest|oldest)\b"
DANGLING = [
    r"\bas (?:computed|shown|derived|calculated|mentioned|noted|discussed) above\b",
    r"\bfrom step\s+\d+\b",
    r"\bin step\s+\d+\b",
    r"\bas (?:we|i) (?:computed|saw|found|noted) (?:above|earlier)\b",
    r"\busing the (?:above|previous) (?:reasoning|calculation|steps?)\b",
    r"\bper my reasoning\b",
    r"\bas reasoned\b",
]
CONTENTLESS = r"^\s*(?:hi+|hey+|hello+|yo+|sup|what'?s up(?:\s+doc)?|good (?:morning|afternoon|evening)|howdy|greetings|test|ping|knock knock|anyone (?:there|home)\??)\s*[!.?]*\s*$"
SENSITIVE = r"\b(?:suicid\w*|kill myself|end my life|self[- ]?harm|hurt(?:ing)? myself|hopeless|want to die|don'?t want to (?:be here|live)|worthless|cutting myself|overdose|depress\w*|anxiety|panic attack|grie(?:f|ving)|abuse[d]?|assault\w*|trauma\w*|crisis|mental health|eating disorder|anorexi\w*|bulimi\w*|relapse)\b"
ROLE_CONFUSION = [
    r"\b(?:the|that|this)\s+(?:\w+\s+){0,2}i\s+(?:made|wrote|created|generated|produced|built|reformatted)\b",
    r"\bmy\s+(?:rewrite|rephrasing|reformatted version|reformatted answer)\b",
    r"\bi(?:'ll| will| can|'d)\s+(?:redo|rewrite|rephrase|reformat|regenerate)\b",
    r"\bi(?:'ll| will| can|'d)\s+try\s+(?:again|rephrasing|rewriting|to rephrase|to rewrite|a rephrasing)\b",
    r"\b(?:ask me (?:a|your|the next)|pose (?:a|your|me a) question|give me your (?:next )?question|quiz me)\b",
    r"\bas an ai\b",
]
DOMAINS = {
    "math": ["calculate", "equation", "integral", "probability", "sum of", "derivative", "solve for", "prime", "factor", "%", "how many"],
    "coding": ["python", "javascript", "function", "code", "bug", "compile", "regex", "algorithm", "class ", "api"],
    "extraction": ["extract", "list all", "parse", "from the following", "table of", "json", "summarize the"],
    "stem": ["physics", "chemistry", "biology", "molecule", "force", "cell", "energy", "quantum"],
    "humanities": ["history", "philosophy", "ethics", "literature", "society", "culture"],
    "reasoning": ["why", "logic", "puzzle", "deduce", "if all", "infer", "step by step"],
    "roleplay": ["pretend", "role-play", "roleplay", "you are a", "act as", "imagine you"],
    "writing": ["write", "poem", "story", "essay", "draft", "compose"],
}
TOPIC_STOPWORDS = (
    "explain describe write what why how outline give tell summarize summarise compute calculate reverse is are the a an of to me please "
    "could would you your about and or in on for with do does can"
).split()
GENDERED_PRONOUNS = "he him his she her hers himself herself".split()
FORM_CONSTRAINTS = ("json_valid", "yaml_valid", "markdown_table", "markdown_format", "limerick_structure")
START_CONSTRAINTS = ("first_letter", "alphabetical_sentence_starts")
GATE_MINIMA = {"coherence": 7, "appropriateness": 7, "reasoning_quality": 7, "reasoning_answer_consistency": 7, "sycophancy_resistance": 7, "factual_grounding": 7, "instruction_following": 6, "user_query_quality": 6}
BAD_FACT = r"\b(?:account|subscription|billing|invoice|payment|password|api[ _-]?key|access[ _-]?token|badge|membership|premium|plan\b|tier[- ]?\d|order[ _-]?number|credit[ _-]?card|ssn|social security|license[ _-]?key)\b"
TRANSFORM_INTENTS = ("reformat", "lexical_constraint", "restyle", "compress", "genre_convert")
MEMORY_INTENTS = ("fact_recall", "fact_update")
SENSITIVE_INTENTS = ("deepen", "expand", "compress", "open_chat", "self_critique")
EXPLORATORY_CUES = (
    "thinking process", "final output", "as per", "as an ai", "i should comply", "i must follow", "policy", "guideline", "safe completion", "disallowed", "openai", "system prompt",
    "system instruction", "persona:", "audience:", "tone:", "format:", "word count", "the user wants me to", "i need to produce", "must honor", "matches the provided", "suggested response", "good response",
)
