"""Fixed vocabularies: values that results depend on, kept as plain data."""

# Audio taxonomy.
AUDIO_CLASSES = (
    "shout", "impact", "gunshot_or_explosion", "engine",
    "tire_squeal", "glass_breaking", "horn", "skidding",
)

# Keywords that resolve to each audio class, in priority order.
AUDIO_KEYWORDS = {
    "shout": ["shout", "yell", "scream"],
    "impact": ["impact", "thump", "thud", "bang", "slam", "smash", "crash", "punch", "hit"],
    "gunshot_or_explosion": [
        "gunshot", "gunfire", "artillery_fire", "artillery", "explosion",
        "explosive", "firework", "boom", "burst", "pop",
    ],
    "engine": ["engine", "vehicle", "car", "vroom"],
    "tire_squeal": ["tire", "tyre", "tire_squeal", "screech", "squeal"],
    "skidding": ["skidding", "skid"],
    "glass_breaking": ["glass", "glass_breaking", "shatter", "shattering"],
    "horn": ["horn", "honk", "honking"],
}

# Visual relations and the participants each one admits.
RELATION_SIGNATURES = {
    "running": "(PersonID)",
    "enter_or_exit_vehicle": "(PersonID, VehicleID)",
    "carrying": "(PersonID, ObjectID)",
    "physical_altercation": "(PersonID, PersonID)",
    "vehicle_collision": "(VehicleID)",
    "gunshot_visible": "(PersonID)",
    "explosion_visible": "(VehicleID?, ObjectID?)",
    "suspicious_near_vehicle": "(PersonID, VehicleID)",
}

# Signature token prefix -> participant class.
SIGNATURE_CLASSES = {"PersonID": "person", "VehicleID": "vehicle", "ObjectID": "object"}

# Suffixes the light stemmer tries, in order.
STEM_SUFFIXES = ("ing", "ed", "ly", "s", "es", "ies", "ness", "tion")

# Patterns of detector responses (a code fence; name(arguments)).
FENCE_PATTERN = r"(?is)```(?:json)?\s*(.*?)\s*```"
RELATION_PATTERN = r"(?i)([a-z_]+)\s*\(([^)\n]*)\)"

# What label cleaning drops, where label tokens break, and what is stripped from words and tokens.
LABEL_DROPPED = "[^a-zA-Z0-9_ ]+"
TOKEN_BREAKS = "[_ ,;:\\-]+"
LABEL_EDGE = "_.,;:!?"
TOKEN_EDGE = "_.,;:!?'\""

STRICTNESS = ("<=", "<", ">=", ">")
PARAMETER_KINDS = ("delta", "epsilon", "zeta", "eta", "rho")
MODALITIES = ("visual", "audio")
EVENTS = (
    "fight", "gunshot_or_explosion", "handoff",
    "suspicious_near_vehicle", "vehicle_collision", "vehicle_escape",
)
