"""Clinical terms that a summary may name only if the call mentions them."""

# Term, pattern in the summary, pattern in the call; matched without regard to case, in their natural order.
TERMS = (
    ("fever", r"\bfever|febrile\b", r"fever|febrile|temperature|\btemp\b|hot to the touch|burning up|chills|thermometer|\b10[0-9](?:\.\d)?\b|one hundred|one oh"),
    ("fall", r"\bfalls?\b|\bfell\b(?! (?:below|under|to\b|from \d))|\bfallen\b", r"fall|fell|fallen|slipped|tripped|on the floor|went down|knocked|stumbled|hit (?:his|her|the)|collapsed|ground"),
    ("chest pain", r"chest pain|chest pressure|chest tightness", r"chest|heart|pressure|tight"),
    ("seizure", r"seizure|seizing|convuls", r"seiz|convuls|shak|jerk|stare|stared|staring|spell|fit\b|twitch|blank|unrespons|lip smack"),
    ("rash", r"\brash|hives\b", r"rash|hive|itch|red spots|bumps|breaking out|welts|blotch|spots"),
    ("bleeding", r"bleed|hemorrhag|nosebleed", r"bleed|blood|bloody|nosebleed|hemorrhag|spotting|red|dark|tarry|coffee|clot|oozing|soaked"),
    ("vomiting", r"vomit|emesis", r"vomit|throw|threw|thrown|throwing up|puk|sick to|heav|retch|spit|spat|gag|upchuck|brought it up|came back up|nause"),
    ("diarrhea", r"diarrh|loose stool", r"diarrh|loose|runny|watery|stool|bowel|poop|accident|liquid|going a lot|bathroom"),
    ("headache", r"headache|migraine", r"headache|head hurt|head is|head pain|migraine|pounding|my head|his head|her head|tired head|temple"),
    ("dizziness", r"dizz|lighthead|vertigo", r"dizz|light ?headed|woozy|spinning|vertigo|faint|room tilt|tilting|unsteady|wobbl|swim|off balance|balance"),
    ("cough", r"\bcough", r"cough|hack|clear (?:his|her|my) throat|wheez|phlegm|mucus|congest"),
    ("swelling", r"swell|swollen|edema", r"swell|swollen|edema|puff|bloat|fluid|retention|tight|big|bigger|tender|enlarge|ankle|legs"),
    ("confusion", r"confus|disorient|delir|hallucinat", r"confus|disorient|mixed up|doesn'?t know|not making sense|nonsens|delir|agitat|out of it|foggy|hallucinat|talking to|seeing|forget|wrong name|calling|not herself|not himself|lost|strange|odd"),
    ("shortness of breath", r"short(?:ness)? of breath|breathless|dyspnea|trouble breathing|difficulty breathing", r"breath|breathing|gasp|winded|wheez|air\b|chok|oxygen|sat(?:uration)?|panting|puffing"),
    ("unresponsive", r"unrespons|unconscious|difficult to wake|hard to wake|not waking", r"unrespons|unconscious|wake|waking|woke|asleep|sleep|limp|passed out|faint|rous|lethar|sleepy|drows|out cold"),
    ("suicidal", r"suicid|wish(?:ed)? to die|self-harm|take all (?:his|her|the|of)", r"die|dead|suicid|kill|end it|ending it|take (?:them )?all|wouldn'?t wake|not wake|better off|hurt(?:ing)? (?:my|your|him|her|them)self|himself|herself|pills|gone|harm|burden|give up|no point|done|hopeless|depress|988|crisis|down\b"),
    ("nausea", r"nause", r"nause|sick to|queasy|upset stomach|stomach|vomit|throw|threw|retch|gag|heav"),
    ("constipation", r"constipat", r"constipat|bowel|\bbm\b|stool|poop|haven'?t gone|hasn'?t gone|haven'?t had|hasn'?t had|backed up|impact|strain|laxative|miralax|senna|colace"),
    ("pain", r"\bpain\b|\bhurt|\bsore\b|\bache|aching|tender", r"pain|hurt|sore|ache|aching|tender|ouch|moan|grimac|uncomfortable|discomfort|burn|cramp|sting|throb|stiff"),
    ("infection", r"infection|\buti\b|pus\b", r"infect|uti\b|urinary|pus\b|discharge|antibiotic|swab|cloudy|smell|foul|red|warm|hot|hurts"),
    ("choking", r"chok|aspirat", r"chok|aspirat|swallow|coughing|gag|went down the wrong|food|drink|stuck|gasp|breath"),
    ("weight gain", r"weight gain|gained .{0,12}pounds", r"weigh|pound|lbs|scale|gain"),
    ("blood pressure", r"blood pressure|\bbp\b", r"blood pressure|\bbp\b|cuff|pressure|\d{2,3} over \d{2,3}|\d{2,3}/\d{2,3}|systolic|reading|monitor"),
    ("oxygen", r"\boxygen\b|\bo2\b", r"oxygen|\bo2\b|concentrator|tank|sat\b|saturation|cannula|nasal|breath|liters?|portable"),
    ("wound", r"\bwound|ulcer|pressure sore|bedsore", r"wound|ulcer|sore|bedsore|pressure|skin|dressing|bandage|red spot|spot|tailbone|bottom|open|broken|blister|bruise|cut\b|scab"),
)
GENERIC_TERMS = ("pain", "blood pressure", "oxygen", "wound", "infection", "weight gain", "swelling", "shortness of breath", "constipation", "nausea", "cough")
SPECIFIC_TERMS = ("fever", "fall", "chest pain", "seizure", "rash", "bleeding", "suicidal", "unresponsive", "choking")
