"""Declared schemas of manifests, traces, enrichment and graphs; nothing is inferred from data."""

from __future__ import annotations

LAYERS = ["ui", "experience", "capability", "domain", "processor", "external", "unknown"]
BROKERS = ["kafka", "rabbitmq", "servicebus", "sns", "sqs", "nats", "other"]
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ANY"]
LEVELS = ["info", "warn", "error"]

LOC = "struct<file:string,line:int>"

#: Columns of the tables that a manifest falls apart into. Each also has m_ord (place of the manifest) and i_ord (place in it).
TABLES = {
    "services": "id string, name string, layer string, owner string, repo string, language string, frameworks array<string>, description string, tags array<string>",
    "handlers": f"service string, id string, kind string, name string, loc {LOC}, calls array<string>, summary string, hash string",
    "endpoints": f"service string, id string, method string, path string, handler string, loc {LOC}, operationId string, summary string",
    "consumers": f"service string, id string, broker string, topic string, exchange string, routingKey string, `group` string, handler string, loc {LOC}",
    "calls": f"service string, id string, method string, url string, targetHint string, targetService string, fromHandler string, loc {LOC}",
    "publishes": f"service string, id string, broker string, topic string, routingKey string, fromHandler string, loc {LOC}",
    "declared": "service string, dep_service string, reason string",
    "issues": f"service string, level string, code string, message string, loc {LOC}",
}

_loc = "location:struct<file:string,line:int>"
MANIFEST = (
    "schemaVersion string, generatedAt string, commit string, generator struct<name:string,version:string>, "
    "service struct<id:string,name:string,layer:string,owner:string,repo:string,language:string,frameworks:array<string>,description:string,tags:array<string>>, "
    f"handlers array<struct<id:string,kind:string,name:string,{_loc},calls:array<string>,summary:string,hash:string>>, "
    f"endpoints array<struct<id:string,method:string,path:string,handler:string,{_loc},operationId:string,summary:string>>, "
    f"consumers array<struct<id:string,broker:string,topic:string,exchange:string,routingKey:string,`group`:string,handler:string,{_loc}>>, "
    f"calls array<struct<id:string,method:string,url:string,targetHint:string,targetService:string,fromHandler:string,{_loc}>>, "
    f"publishes array<struct<id:string,broker:string,topic:string,routingKey:string,fromHandler:string,{_loc}>>, "
    "declaredDependencies array<struct<service:string,reason:string>>, "
    f"issues array<struct<level:string,code:string,message:string,{_loc}>>"
)

EDGE = f"id string, kind string, source string, target string, fromHandler string, endpoint string, routingKey string, method string, url string, status string, resolution string, confidence double, loc {LOC}"
ISSUE = f"level string, code string, service string, message string, loc {LOC}"
TRACE_ROW = "struct<source:string,parent:string,client:string,target:string,child:string,server:string,count:double,callCount:double>"
ENRICHMENT = "service string, description string, handlers map<string,struct<summary:string,hash:string>>, endpoints map<string,struct<summary:string,useCase:string>>"
FLOW_ENRICHMENT = "flows map<string,struct<name:string,useCase:string,description:string,steps:map<string,string>>>"
