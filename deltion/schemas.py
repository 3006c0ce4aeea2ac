"""Declared schemas of landed JSON. Missing fields read as null; unreadable records are kept aside."""

CANDIDATE = (
    "struct<eshidis_id:string,title:string,authority_name:string,published_at:string,submission_deadline:string,"
    "status:string,budget:string,totalCostWithVAT:string,totalCostWithoutVAT:string,totalCost:string,estimatedValue:string,row_text:string>"
)
CANDIDATE_REPORT = f"struct<candidates:array<{CANDIDATE}>>"

NOTICE = (
    "struct<referenceNumber:string,title:string,organization:struct<value:string,name:string>,organizationName:string,authorityName:string,"
    "submissionDate:string,signedDate:string,finalSubmissionDate:string,cancelled:boolean,budget:string,totalCostWithVAT:string,"
    "totalCostWithoutVAT:string,totalCost:string,estimatedValue:string,estTotalCost:string,awardTotalCost:string>"
)
NOTICE_PAGE = f"struct<content:array<{NOTICE}>>"

POSTS = (
    "array<struct<id:string,link:string,date:string,title:struct<rendered:string>,content:struct<rendered:string>,excerpt:struct<rendered:string>>>"
)
DECISIONS = (
    "struct<decisions:array<struct<ada:string,adaCode:string,subject:string,protocolNumber:string,documentUrl:string,issueDate:string,"
    "submissionTimestamp:string,publishTimestamp:string>>>"
)
EU_NOTICES = (
    "struct<notices:array<struct<`publication-number`:string,`publication-date`:string,`notice-title`:map<string,string>,"
    "links:struct<html:map<string,string>,htmlDirect:map<string,string>,pdf:map<string,string>,xml:map<string,string>>>>>"
)
