"""Patterns of the risk rules."""

# Regular expressions that results depend on, matched without regard to case, in their natural order.
HIGH_NUMBER = r"(?:7|8|9|10|seven|eight|nine|ten)"
NEGATED_BEFORE = r"\b(?:no|not|never|without|denies|denied|nothing|hasn'?t|haven'?t|isn'?t|aren'?t|wasn'?t|doesn'?t|don'?t|didn'?t|can'?t say|none|nor|neither|zero)\b"
CONDITIONAL = r"\b(?:if|when|whenever|should|in case|any time|anytime|once|unless|say|call us for|call us if)\b"
MEDICINE = r"medic|\bmeds?\b|\bpills?\b|tablet|capsule|\bdoses?\b|insulin|patch|injection|syringe|inhaler|refill|prescri|liquid|drops"
PAIN_ASK = r"(?=.*(?:pain|hurt|ache|sore))(?=.*(?:scale|number|zero to ten|0 to 10|how bad|how much|rate|rating|how strong|how severe|how would you))"
HISTORICAL = r"last time|years? ago|months? ago|weeks? ago|used to|history of|in the past|back in|when (?:i|he|she) was|once before|before this|previously|last year"
NO_UNIT_AFTER = r"(?!\s*(?:years|days|day|weeks|hours|hour|minutes|pounds|units|mg|ml|times|o'?clock|am|pm|a\.m|p\.m|milligram|milliliter|tablet|pill))"
SIGNALS = (
    r"\bpain|hurt|ache|sore\b",
    r"\bmedic|\bpills?\b|\bdoses?\b|\bmg\b|\bml\b|tablet|capsule|prescri|refill",
    r"insulin|glucose|sugar|blood pressure|\bbp\b",
    r"oxygen|concentrator|tank|cannula|nebuliz|inhaler|tubing|catheter|dressing|wound|supplies|diaper|brief|ostomy|feeding tube|commode|walker|wheelchair|hospital bed",
    r"fever|vomit|nause|dizz|cough|breath|swell|constipat|diarrh|bleed|\bfall\b|\bfell\b|rash|seiz|confus|agitat|restless|sleepy|eating|drinking|appetite|bowel|urine|urin|weight|stool|swallow",
    r"nurse (?:will|can|is going)|visit|on-call|clinician|the doctor|physician|social worker|chaplain|hospice|symptom|patient",
    r"\bdate of birth\b|\bdob\b|born in|birthday",
)
#: category, rule, speaker, suppressed after a negation, needs talk of medicines, pattern
RULES = (
    ("suicidal_statement", "self_negative_wording", "Caller", False, False, r"(?:don'?t|do not|doesn'?t) want to (?:live|be here|wake up|go on|be alive|do this anymore)|(?:wish|hope|want|wanting|rather|if only)[^.?!]{0,25}(?:wouldn'?t|would not|not|never) wake up|go to sleep and (?:not|never) wake up|better off (?:dead|gone|without)|want(?:s|ed)? to die|(?:no|not any) (?:reason|point) (?:to|in) (?:live|living|go on)|\bend(?:ing)? (?:it all|my life|his life|her life|everything)|thinking (?:about|of) (?:ending|suicide|killing)|suicid|kill(?:ing)? (?:myself|himself|herself)(?![^.?!]{0,25}\b(?:if|when|every time|one more time)\b)|take (?:all|them all|all of them)(?: of)? (?:the |my |his |her )?(?:pills|them|medicines?|meds)|take them all|take all (?:of )?(?:them|these|those)|i'?d be better off|done with (?:life|everything|it all)|wish (?:i|he|she) (?:was|were) dead|not be here anymore|can'?t go on"),
    ("suicidal_statement", "self_harm_wording", "Caller", True, False, r"hurt (?:myself|himself|herself)|harm (?:myself|himself|herself)|\bend it\b|\bending it\b"),
    ("breathing_concern", "cannot_breathe", "Caller", True, False, r"can'?t (?:breathe|catch (?:his|her|my|their) breath)|cannot breathe|\bgasping\b|struggling to breathe|working (?:so |really )?hard to breathe|not breathing|stopped breathing|turning blue|(?:blue|bluish|gray|grey) (?:lips|around)|lips (?:are |look |turned )?(?:blue|gray|grey)|throat (?:is |'s )?(?:tight|closing)|\bchoking\b|chest (?:pain|tight)|tightness in (?:his|her|my|the) chest|wheezing"),
    ("breathing_concern", "hard_to_breathe", "Caller", True, False, r"hard (?:time )?(?:to )?breath|trouble breathing|difficulty breathing|(?:short(?:ness)?|out) of breath|breathless|labored breathing|breathing (?:fast|hard|so fast|is fast|really fast|heavy|heavily)|fast breathing"),
    ("escalation_request", "caller_urgent_help", "Caller", True, False, r"(?:send|get) (?:someone|a nurse|the nurse|somebody|an ambulance)(?: out| over| here)?[^.?!]{0,20}?(?:now|right now|right away|immediately|as soon as)|(?:need|want) (?:someone|a nurse|the nurse|somebody)(?: to come| out)?[^.?!]{0,15}?(?:now|right now|right away|immediately)|(?:need|want) (?:you|someone|a nurse|somebody|the nurse) to come(?: out| over)?[^.?!]{0,10}?(?:now|right now|right away|immediately|today|tonight)|(?:need|want) (?:an )?ambulance|\bcall (?:911|nine one one)\b|\bcan (?:someone|somebody|a nurse|the nurse|anyone) (?:please )?(?:come|get here)|(?:want|need) (?:him|her|them) in the (?:emergency (?:department|room)|er)"),
    ("escalation_request", "nurse_911_ed", "Nurse", True, False, r"(?:call|dial) (?:911|nine one one)(?: right)? (?:now|away|immediately)|hang up and call (?:911|nine one one)|(?:i'?m|i am|we'?re|we are) (?:calling|sending|dispatching) (?:911|nine one one|an ambulance|ems|paramedics)|(?:go|take (?:him|her|them)|get (?:him|her|them)|head) to the (?:er|emergency (?:room|department)|hospital)[^.?!]{0,12}?(?:now|right away|immediately)|(?:911|nine one one)[^.?!]{0,10}?(?:right )?(?:now|away)|call (?:an )?ambulance"),
    ("escalation_request", "nurse_urgent_visit", "Nurse", False, False, r"(?:i'?m|i am) sending (?:a nurse|someone|the nurse|our nurse)[^.?!]{0,25}?(?:now|right now|right away|immediately|within the hour|within an hour)|nurse will be there (?:within|in) (?:the hour|an hour|thirty|30|twenty|20|forty|45)|(?:send|sending) (?:a nurse|someone) (?:out )?(?:now|right now|right away|immediately)"),
    ("medication_concern", "ran_out", "Caller", True, True, r"(?:ran|run|running|runs) out(?: of)?|\bout of (?:his|her|my|the|their|our)\b|no (?:more|doses) left|last (?:dose|pill|tablet)"),
    ("medication_concern", "wrong_or_extra", "Caller", True, True, r"too much|wrong (?:pill|medicine|medication|insulin|dose|one|bottle|strength|syringe|drug)|double(?:d)? (?:dose|up|the)|extra (?:dose|pill|tablet|one|time)|overdos|took (?:two|an extra|another|one more|a second|the wrong|too)|took (?:a |an |one |the )?\w+ and (?:then )?(?:i )?took (?:another|a second|one more)|gave (?:him|her|them)[^.?!]{0,25}(?:twice|an extra|another|two|the wrong|too)|(?:twice|two times)[^.?!]{0,20}(?:already|in a row|by mistake)|by mistake|mix(?:ed)? up|messed up|took the wrong|gave the wrong|two (?:pills|tablets|doses) (?:instead|by)|took (?:it|them) (?:twice|again)|took (?:it|them) two times"),
    ("medication_concern", "stopped_missed", "Caller", True, True, r"stopp(?:ed|ing) (?:taking|giving|the|his|her|my|it|them)|(?:forgot|missed|skipped|didn'?t get) (?:a |the |his |her |to give |any )?(?:dose|doses|pill|pills|medic\w*|his|her|them|it)|hasn'?t had (?:his|her) (?:\w+ )?(?:medic\w*|pill|dose|morphine|insulin)|can'?t (?:swallow|keep down)"),
    ("uncontrolled_symptom", "pain_score_high", "Caller", False, False, r"\b(?:7|8|9|10|seven|eight|nine|ten) out of (?:10|ten)\b|\b(?:7|8|9|10)\s*/\s*10\b|(?:pain|hurts?|hurting)[^.?!]{0,25}\b(?:7|8|9|10|seven|eight|nine|ten)\b(?!\s*(?:years|days|day|weeks|hours|hour|minutes|pounds|units|mg|ml|times|o'?clock|am|pm|a\.m|p\.m|milligram|milliliter|tablet|pill))|\b(?:7|8|9|10|seven|eight|nine|ten)\b(?!\s*(?:years|days|day|weeks|hours|hour|minutes|pounds|units|mg|ml|times|o'?clock|am|pm|a\.m|p\.m|milligram|milliliter|tablet|pill))[^.?!]{0,15}(?:pain|hurts)"),
    ("uncontrolled_symptom", "not_relieved", "Caller", True, False, r"(?:it|that|this|morphine|medicine|medication|pills?|dose|they|nothing)\s+(?:is |are |was |were )?(?:not|n'?t) (?:helping|working|touching|helped|enough)|\b(?:isn'?t|aren'?t|wasn'?t|hasn'?t|haven'?t|didn'?t|doesn'?t) (?:helping|working|touching|helped|help)|no relief|still (?:in pain|hurting|hurts|screaming|moaning)|thrashing|writhing|screaming|unbearable|worst pain|excruciating|crying out|nothing (?:helps|works)"),
    ("other_urgent", "seizure", "Caller", True, False, r"seizure|seizing|convuls"),
    ("other_urgent", "fall_injury", "Caller", True, False, r"(?:fell|fall|fallen|slipped|tripped|found (?:him|her) on the floor|on the floor)[^.?!]{0,60}(?:head|bleed|blood|broke|cut|bruis|swollen|can'?t (?:move|stand|walk|get up)|hip|hurt)|(?:hit|banged|bumped) (?:his|her|my|the) head|hit (?:it|the) \w+ on the"),
    ("other_urgent", "bleeding", "Caller", True, False, r"bleeding|blood (?:from|in|coming|on)|nosebleed|(?:throwing up|vomit\w*|threw up) (?:bright )?(?:red )?blood|coffee grounds|black (?:and )?tarry|black stool|bright red blood|bloody"),
    ("other_urgent", "death_arrest", "Caller", True, False, r"passed away|has died|just died|stopped breathing|no pulse|isn'?t breathing(?! (?:hard|fast|heavy|heavily|well|right))|not breathing(?! (?:hard|fast|heavy|heavily|well|right))|he'?s gone|she'?s gone|funeral home"),
    ("other_urgent", "neuro_emergency", "Caller", True, False, r"face (?:is )?(?:drooping|falling)|slurred|(?:having|think .{0,12}) a stroke|can'?t move (?:his|her) (?:arm|leg)|unresponsive|(?:he|she|they|patient)\s+won'?t wake|not waking|can'?t wake|hard to wake|unconscious|passed out|collapsed"),
)

# What a question, a time, a continued list and a condition look like, and the words of a number.
PLEA = r"\bcan (?:someone|somebody|a nurse|the nurse|anyone)"
LATER = r"before|after|between|tomorrow|next|monday|tuesday|wednesday|thursday|friday|saturday|sunday|morning|usual|regular|schedul|later"
CONTINUES = r"(?:then|and then|so then)\b"
RETURN = r"[^.?!]{0,25}\b(?:if|when|for|should)\b"
SPOKEN_NUMBER = r"\b(?:\d+|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|hundred|thousand|point|oh)\b"
