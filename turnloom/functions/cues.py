"""Cue phrases that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Regular expressions of the cues, matched as whole words without regard to case, in their natural order.
HEDGE = (
    r"i think", r"i guess", r"maybe", r"not (?:really )?sure", r"i don'?t know", r"don'?t (?:really )?remember", r"can'?t remember", r"probably",
    r"i believe", r"or so", r"i'?m trying to remember", r"let me think", r"might (?:be|have)", r"i'?m pretty sure", r"i suppose", r"something like",
    r"i (?:can'?t|cannot) tell", r"not certain", r"i'?m not positive", r"perhaps", r"seems? like",
)
SOFTENER = (
    r"about", r"around", r"approximately", r"approx", r"roughly", r"estimated", r"estimate", r"maybe", r"possibly", r"possible", r"probably",
    r"unsure", r"unclear", r"uncertain", r"not sure", r"not certain", r"reportedly", r"thought", r"appeared", r"seemed", r"seems", r"believed",
    r"guess(?:ed)?", r"could not say", r"couldn'?t say", r"did not know", r"didn'?t know", r"unable to (?:say|recall)", r"does not remember",
    r"did not remember", r"could not remember", r"or so", r"somewhat", r"may have", r"might", r"not clear", r"heard as", r"conflict",
)
NEGATION = (
    r"no", r"not", r"none", r"never", r"nothing", r"without", r"denies", r"denied", r"deny", r"negative", r"neither", r"nor", r"hasn'?t", r"haven'?t",
    r"hadn'?t", r"isn'?t", r"aren'?t", r"wasn'?t", r"weren'?t", r"doesn'?t", r"don'?t", r"didn'?t", r"can'?t", r"cannot", r"won'?t", r"wouldn'?t",
    r"couldn'?t", r"absent", r"free of", r"nothing",
)
NORMAL_STATE = (
    r"normal", r"fine", r"well", r"comfortable", r"comfortably", r"stable", r"clear", r"intact", r"okay", r"ok", r"good", r"settled", r"resting",
    r"at baseline", r"unchanged", r"alert", r"steady", r"easy", r"easily", r"calm", r"breathing",
)
COMPLETION = (
    r"it'?s done", r"that'?s done", r"all done",
    r"already (?:\w+ )?(?:sent|put|paged|placed|called|messaged|ordered|scheduled|submitted|done|made|added|notified|contacted)", r"i already",
    r"we already", r"i'?ve got (?:the|that|it|a|your)\b", r"i'?ve (?:started|begun|opened|got it|got that)",
    r"i'?ve (?:\w+ )?(?:sent|put|placed|paged|messaged|called|ordered|submitted|scheduled|notified|added|made|left|emailed|faxed|logged|documented|entered|contacted|requested|moved|changed|updated|booked|arranged|confirmed|spoken)",
    r"i have (?:\w+ )?(?:sent|put|placed|paged|messaged|called|ordered|submitted|scheduled|notified|added|made|left|requested|moved|updated|booked)",
    r"we'?ve (?:\w+ )?(?:sent|put|placed|paged|called|ordered|scheduled)", r"just (?:sent|put|paged|called|messaged|ordered|placed|submitted)",
    r"has been (?:sent|paged|ordered|placed|scheduled|called|messaged|submitted|notified|moved|updated)", r"was just (?:sent|paged|placed)",
    r"i (?:sent|paged|messaged|ordered|placed|submitted|scheduled|notified|moved|changed|updated|booked) ",
    r"i (?:reached|spoke|talked|called|sent|paged|messaged|ordered|placed|submitted|scheduled|notified|moved|changed|updated|booked|recorded|documented|entered|noted|logged|confirmed|left|requested|arranged|contacted|emailed|faxed|checked|looked)\b",
    r"i'?ve \w+ed\b", r"i did (?:reach|call|send|page|message|order|talk|speak|get|contact|put|place|schedule|submit)\b", r"i just \w+(?:ed|t)\b",
    r"it'?s on the schedule", r"it is on the schedule", r"you'?re (?:all )?(?:set|scheduled|booked)", r"already (?:on|scheduled|booked)",
    r"(?:was|were|has been|have been) (?:\w+ )?(?:ordered|sent|placed|submitted|scheduled|paged|called|messaged|put in|entered|documented|recorded|confirmed|delivered|dispatched)\b",
)
FUTURE = (
    r"i'?ll", r"i will", r"i'?m going to", r"i am going to", r"going to", r"let me", r"we'?ll", r"we will", r"gonna", r"i'?d like to", r"i can",
    r"i could", r"i'?d (?:go ahead|have|get)", r"will (?:be|have|get|send|call|page|message)", r"i'?m (?:about|planning) to", r"i should",
    r"want to (?:send|call|page|message|schedule|order)", r"need to (?:send|call|page|message|schedule|order)", r"someone will", r"they will",
    r"they'?ll", r"he will", r"she will", r"within the (?:hour|day)", r"by (?:tomorrow|tonight|this)", r"tomorrow", r"later (?:today|tonight)",
)
NOW_PROGRESS = r"\bi'?m (?:\w+ing)\b[^.?!]{0,60}\b(?:now|right now)\b|\bright now\b|as we speak|while (?:we'?re|you'?re) (?:talking|on|here)|\bnow\b[.?!]?\s*$"
PLANNED_TEXT = r"^\s*(planned|plans|will|to be|scheduled to|to |arranged to|intend|going to)"
DONE_TEXT = r"^\s*(completed|already|done|has been|was (?:sent|paged|placed|ordered)|sent|paged|ordered|placed)\b"


def says(text: Column, cues: tuple[str, ...] | str) -> Column:
    """Does a text hold one of the cues? A null text holds none."""
    pattern = cues if isinstance(cues, str) else rf"\b(?:{'|'.join(cues)})\b"
    return F.coalesce(text.rlike(f"(?i)(?:{pattern})"), F.lit(False))
