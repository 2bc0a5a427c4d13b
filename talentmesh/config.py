"""Fixed values and tunable defaults.

Everything in the "fixed values" blocks must equal the behaviour being
reproduced for results to match; everything else is a default a caller
may override.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Score weights, in the order the components are summed.
# The summation order matters for floating point, so keep it.
# ---------------------------------------------------------------------------
COMPONENTS = (
    "required_skills",
    "preferred_skills",
    "other_skills",
    "qualifications",
    "responsibilities",
    "industry",
    "role",
    "location",
)

DEFAULT_WEIGHTS = {
    "required_skills": 0.15,
    "preferred_skills": 0.15,
    "other_skills": 0.25,
    "qualifications": 0.15,
    "responsibilities": 0.15,
    "industry": 0.05,
    "role": 0.05,
    "location": 0.05,
}

# Skill points (hit, fuzzy) for required and for other lists.
REQUIRED_POINTS = (3, 2)
OPTIONAL_POINTS = (1, 1)

# Categorical match points (equal, contained, neither).
INDUSTRY_POINTS = (3, 2, 0)
ROLE_POINTS = (3, 2, 0)
LOCATION_POINTS = (2, 1, 0)

# Score cap, match threshold (inclusive), display precision.
SCORE_CAP = 100.0
MATCH_THRESHOLD = 85.0
SCORE_DECIMALS = 2

# Null default written by the extract queries.
UNKNOWN = "Unknown"

# List delimiters.
LIST_DELIMITER = "; "          # skill categories, education, experience
OTHER_SKILLS_DELIMITER = ", "  # other skills
JOB_SKILL_SEPARATOR = ","      # job skill fragments (no trimming)
EDUCATION_SEP = " - "
EXPERIENCE_AT = " at "

# Timestamp text format of the extract (seconds precision).
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Characters Python's str.split() treats as whitespace.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The ten skill categories of the member extract, in output
# order: (category, bridge table, dimension table, bridge FK column,
#         dimension name column, dimension description column,
#         output names column, output descriptions column)
CATEGORIES = (
    ("Communication", "Member_Communications", "Communication", "CommunicationId",
     "CommunicationName", "CommunicationDescription",
     "CommunicationNames", "CommunicationDescriptions"),
    ("Leadership", "Member_Leaderships", "Leadership", "LeadershipId",
     "LeadershipName", "LeadershipDescription",
     "LeadershipNames", "LeadershipDescriptions"),
    ("CriticalThinking", "Member_Critical_Thinkings", "CriticalThinking", "Critical_ThinkingId",
     "CriticalThinkingName", "CriticalThinkingDescription",
     "CriticalThinkingNames", "CriticalThinkingDescriptions"),
    ("Collaboration", "Member_Collaborations", "Collaboration", "CollaborationId",
     "CollaborationName", "CollaborationDescription",
     "CollaborationNames", "CollaborationDescriptions"),
    ("Character", "Member_Characters", "Character", "CharacterId",
     "CharacterName", "CharacterDescription",
     "CharacterNames", "CharacterDescriptions"),
    ("Creativity", "Member_Creativitys", "Creativity", "CreativityId",
     "CreativityName", "CreativityDescription",
     "CreativityNames", "CreativityDescriptions"),
    ("GrowthMindset", "Member_Growth_Mindsets", "GrowthMindset", "Growth_MindsetId",
     "GrowthMindsetName", "GrowthMindsetDescription",
     "GrowthMindsetNames", "GrowthMindsetDescriptions"),
    ("Mindfulness", "Member_Mindfulness", "Mindfulness", "MindfulnessId",
     "MindfulnessName", "MindfulnessDescription",
     "MindfulnessNames", "MindfulnessDescriptions"),
    ("Fortitude", "Member_Fortitudes", "Fortitude", "FortitudeId",
     "FortitudeName", "FortitudeDescription",
     "FortitudeNames", "FortitudeDescriptions"),
    ("TechnicalSkills", "Member_TechnicalSkills", "TechnicalSkills", "TechnicalSkillId",
     "TechnicalSkillsName", "TechnicalSkillsDescription",
     "TechnicalSkillNames", "TechnicalSkillDescriptions"),
)

# Job extract columns in output order.
JOB_COLUMNS = (
    "Id", "JobCode", "JobTitle", "EmploymentTypeId", "EmploymentTypeName",
    "CityId", "CityName", "PostedDate", "Deadline_for_Applications",
    "Salary_Range_Start", "Salary_Range_End", "JobLocation", "Description",
    "Qualifications", "PreferredSkills", "Required_Skills",
    "Key_Responsibilities", "Industry", "Role", "IsActive", "CreatedDate",
    "ModifiedDate",
)

# Member extract head columns (before the category columns).
MEMBER_HEAD_COLUMNS = (
    "MemberId", "MemberFirstName", "MemberLastName", "MemberEmail", "IsActive",
    "CreatedDate", "ModifiedDate", "MemberEthnicityId", "MemberGenderId",
    "Age_Id", "AgeName", "CityId", "CityName", "EthnicityName", "Headline",
)
MEMBER_TAIL_COLUMNS = ("Education", "Experience", "OtherSkills")

# Display names of the ranking document.
JOB_DETAIL_FIELDS = (
    ("Job Id", "Id"),
    ("Job Title", "JobTitle"),
    ("Job Code", "JobCode"),
    ("City", "CityName"),
    ("Job Location", "JobLocation"),
    ("Employment Type", "EmploymentTypeName"),
    ("Posted Date", "PostedDate"),
    ("Deadline for Applications", "Deadline_for_Applications"),
    ("Is Active", "IsActive"),
    ("Salary Range Start", "Salary_Range_Start"),
    ("Salary Range End", "Salary_Range_End"),
)
MATCHED_MEMBER_FIELDS = (
    ("Member Id", "MemberId"),
    ("Member First Name", "MemberFirstName"),
    ("Member Last Name", "MemberLastName"),
    ("Member Email", "MemberEmail"),
    ("City", "CityName"),
)


@dataclass(frozen=True)
class MatchOptions:
    """Caller-tunable options; defaults reproduce the reference behaviour."""

    weights: dict = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    threshold: float | None = MATCH_THRESHOLD   # None keeps every pair
    prune: bool = True                          # lossless score-bound pruning
    top_k: int | None = None                    # None keeps every match
