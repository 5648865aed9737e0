"""Schemas of the documents that sources hold, spelled out so that nothing is inferred."""

TERM = "struct<chamber: string, endYear: int>"
MEMBER = f"bioguideId string, name string, partyName string, state string, district string, imageUrl string, terms array<{TERM}>"
MEMBER_VOTE = "struct<name: string, bioguideId: string, lisMemberId: string, party: string, state: string, voteCast: string>"
VOTE = f"struct<chamber: string, congress: int, sessionNumber: int, rollNumber: int, recordedAt: string, sourceUrl: string, question: string, result: string, voteDate: string, members: array<{MEMBER_VOTE}>>"
BILL = f"congress string, billType string, billNumber string, title string, updateDate string, summaries array<struct<text: string, actionDate: string>>, votes array<{VOTE}>"
BILL_DETAIL = "billId string, congress int, type string, number string, title string, summary string, latestAction struct<actionDate: string, text: string, actionTime: string>, subjects array<string>, cosponsors int, url string"
RELEASE = "struct<url: string, title: string, date: string, publishedTime: string, bodyHtml: string, bodyText: string>"
CORPUS = f"scrapedAtUtc string, membersByBioguideId map<string, struct<bioguideId: string, name: string, state: string, partyName: string, status: string, error: string, releaseCount: int, pressReleases: array<{RELEASE}>>>"
SENATE_XML = "members struct<member: array<struct<member_full: string, last_name: string, first_name: string, party: string, state: string, vote_cast: string, lis_member_id: string>>>"
HOUSE_XML = "`vote-data` struct<`recorded-vote`: array<struct<legislator: struct<`_VALUE`: string, `_name-id`: string, `_party`: string, `_state`: string>, vote: string>>>"
#: The topics of an issue profile.
TOPICS = (
    "abortion", "budget_economy", "civil_rights", "corporations", "crime", "drugs", "education", "energy_oil", "environment", "families_children", "foreign_policy", "free_trade",
    "government_reform", "gun_control", "health_care", "homeland_security", "immigration", "jobs", "principles_values", "social_security", "tax_reform", "technology", "war_peace", "welfare_poverty",
)
#: How sure and how grave a contradiction may be.
SEVERITIES = ("direct", "moderate", "weak", "nuanced")
CONTRADICTION = "contradictionId string, issueCategory string, severity string, statementId string, billId string, memberVote string, extractedStance string, confidenceScore double"
