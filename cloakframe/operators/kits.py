"""Vendor kits: how exports of common products name their fields.

A kit has weighted fingerprints (names that tell the product) and ordered rules (pattern of a name,
action, kind); the first rule that matches decides.  ``load`` reads further kits from JSON files, which
extend a kit of the same id (their rules first) or replace it.  The names follow the vendors' public
field references.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Kit:
    id: str
    label: str
    fingerprints: dict[str, float]
    rules: tuple[tuple[str, str, str | None], ...]
    aliases: tuple[str, ...] = ()


def _kit(id: str, label: str, prints: str, ip: str = "", user: str = "", host: str = "", email: str = "", opaque: str = "", text: str = "", keep: str = "", domain: str = "", aliases: tuple[str, ...] = ()) -> Kit:
    """A kit from lists of names; a fingerprint written ``name*3`` weighs 3 (2 otherwise)."""
    weights = {p.partition("*")[0].lower(): float(p.partition("*")[2] or 2) for p in prints.split()}
    parts = (("mask", "ip", ip), ("mask", "user", user), ("mask", "endpoint", host), ("mask", "email", email), ("mask", "fqdn", domain), ("mask", "opaque", opaque), ("text", None, text), ("keep", None, keep))
    return Kit(id, label, weights, tuple((re.escape(n).replace(r"\*", ".*"), action, kind) for action, kind, names in parts for n in names.split()), aliases)


_ALL = (
    _kit("acronis", "Acronis", "resource_name*3 plan_name*3 protection_plan*4 agent_id customer_name*3", host="resource_name", user="initiator", opaque="agent_id tenant_id", text="details", keep="severity plan_name"),
    _kit("aws_cloudtrail", "AWS CloudTrail", "eventsource*3 awsregion*4 useridentity.arn*4 sourceipaddress*3 recipientaccountid*4 eventversion useragent", ip="sourceipaddress", user="useridentity.username useridentity.sessioncontext.sessionissuer.username", opaque="useridentity.arn useridentity.accountid useridentity.principalid useridentity.accesskeyid recipientaccountid requestid eventid", text="requestparameters* responseelements* errormessage", keep="eventsource eventname awsregion eventversion eventtype useragent"),
    _kit("bitdefender", "Bitdefender", "computer_name*2 computer_ip*3 computer_fqdn*4 product_installed*4 malware_name*3 bdfw_module*4", ip="computer_ip", host="computer_name computer_fqdn", user="user.name username", opaque="computer_id endpointid", text="file_path process_path", keep="malware_name malware_type status module"),
    _kit("cisco_secure_endpoint", "Cisco Secure Endpoint", "connector_guid*4 computer.hostname*3 computer.external_ip*3 group_guids*3 detection_id", ip="computer.external_ip computer.network_addresses.ip", host="computer.hostname", user="computer.user", opaque="connector_guid group_guids computer.connector_guid", text="file.file_path", keep="event_type detection severity"),
    _kit("cortex", "Palo Alto Cortex XDR", "agent_hostname*3 actor_effective_username*4 causality_actor_process_command_line*4 action_local_ip*3 action_remote_ip*3 agent_id", ip="action_local_ip action_remote_ip agent_ip_addresses host_ip", host="agent_hostname action_external_hostname host_name", user="actor_effective_username causality_actor_effective_username user_name", domain="dns_query_name", opaque="agent_id external_id", text="*command_line *_message action_file_path *image_path", keep="severity alert_id category name action action_pretty mitre_*"),
    _kit("crowdstrike", "CrowdStrike Falcon", "aid*3 cid*2 computername*2 localaddressip4*4 targetprocessid*3 event_simplename*4 falconhostlink*4 detectid", ip="localaddressip4 remoteaddressip4 aip localip", host="computername machinename", user="username userprincipal", opaque="aid cid detectid sensorid targetprocessid", text="commandline filepath imagefilename detectdescription", keep="severity severityname event_simplename tactic technique"),
    _kit("darktrace", "Darktrace", "pbid*4 modelname*3 breachurl*4 devicehostname*3 deviceip*2 triggeredcomponents*3", ip="deviceip sourceip destip", host="devicehostname sourcehost desthost", opaque="pbid did sid", text="breachurl message", keep="modelname score"),
    _kit("elastic_ecs", "Elastic Common Schema", "ecs.version*4 event.dataset*3 event.module*2 agent.type*2 host.os.family*2 log.level process.entity_id data_stream.dataset*3", ip="source.ip destination.ip client.ip server.ip host.ip related.ip observer.ip source.nat.ip destination.nat.ip", host="host.name host.hostname agent.name agent.hostname observer.name source.address destination.address related.hosts", user="user.name user.target.name user.effective.name related.user winlog.user.name", email="user.email email.from.address email.to.address", domain="user.domain host.domain url.domain dns.question.name source.domain destination.domain", opaque="host.id agent.id user.id agent.ephemeral_id process.entity_id cloud.account.id cloud.instance.id", text="message event.original process.command_line process.args url.original url.full file.path log.file.path error.message", keep="event.action event.category event.outcome event.severity event.code event.dataset ecs.version rule.name"),
    _kit("exabeam", "Exabeam", "exa_raweventtime*4 exa_category*4 exa_parser_name*4 rule_labels*2 riskscore src_host dest_host", ip="src_ip dest_ip", host="src_host dest_host host", user="user account", email="email email_address", opaque="session_id", text="raw_log rawlog", keep="exa_* riskscore rule_name rule_labels"),
    _kit("fortinet", "Fortinet FortiGate", "devname*2 devid*3 logid*3 vd*2 srcintf*3 dstintf*3 policyid*2 subtype srcip", ip="srcip dstip tranip transip remip locip", host="devname srcname dstname hostname", user="user srcuser dstuser unauthuser", opaque="devid", text="msg url", keep="logid type subtype level vd policyid action service proto srcport dstport"),
    _kit("microsoft_defender", "Microsoft Defender XDR", "devicename*2 deviceid*2 actiontype*3 initiatingprocessfilename*4 initiatingprocesscommandline*4 reportid*2 accountupn*2 accountsid", ip="remoteip localip publicip ipaddress senderipv4", host="devicename", user="accountname initiatingprocessaccountname accountupn initiatingprocessaccountupn", email="senderfromaddress recipientemailaddress sendermailfromaddress", domain="accountdomain remotednsname", opaque="deviceid accountobjectid aaddeviceid networkmessageid", text="processcommandline initiatingprocesscommandline folderpath remoteurl additionalfields filename", keep="actiontype severity reportid category"),
    _kit("microsoft_entra", "Microsoft Entra ID", "userprincipalname*2 appdisplayname*3 conditionalaccessstatus*4 correlationid risklevelaggregated*3 authenticationrequirement*3 createddatetime", ip="ipaddress", user="userprincipalname userdisplayname initiatedby.user.userprincipalname", host="devicedetail.displayname", opaque="userid correlationid appid id devicedetail.deviceid resourceid", text="additionaldetails*", keep="appdisplayname conditionalaccessstatus risk* status.errorcode clientappused createddatetime authenticationrequirement"),
    _kit("microsoft_sentinel", "Microsoft Sentinel", "timegenerated*2 tenantid*2 systemalertid*4 workspacesubscriptionid*4 alertseverity*3 compromisedentity*3 providername", host="compromisedentity computer", user="account", ip="computerip", opaque="tenantid systemalertid workspacesubscriptionid", text="description extendedproperties entities", keep="alertname alertseverity providername timegenerated"),
    _kit("okta", "Okta", "actor.alternateid*4 actor.displayname*2 client.ipaddress*3 eventtype outcome.result*2 debugcontext.debugdata.requesturi*4 legacyeventtype*3", ip="client.ipaddress", user="actor.displayname target.displayname", email="actor.alternateid target.alternateid", opaque="actor.id target.id transaction.id authenticationcontext.externalsessionid", text="displaymessage debugcontext*", keep="eventtype outcome.* severity"),
    _kit("proofpoint", "Proofpoint", "guid qid*3 fromaddress*3 toaddresses*3 messageparts*4 threatsinfomap*4 spamscore*3 senderip", ip="senderip", email="fromaddress toaddresses sender recipient ccaddresses", opaque="guid qid messageid", text="subject messageparts* threatsinfomap*", keep="spamscore phishscore malwarescore"),
    _kit("sentinelone", "SentinelOne", "agentrealtimeinfo.agentcomputername*4 agentdetectioninfo.agentipv4*4 threatinfo.threatname*4 threatinfo.confidencelevel*3 agentdetectioninfo.siteid*3", ip="agentdetectioninfo.agentipv4 agentdetectioninfo.externalip", host="agentrealtimeinfo.agentcomputername", user="agentdetectioninfo.agentlastloggedinusername threatinfo.processuser", opaque="id agentdetectioninfo.siteid agentrealtimeinfo.agentid", text="threatinfo.filepath threatinfo.maliciousprocessarguments", keep="threatinfo.threatname threatinfo.confidencelevel threatinfo.classification"),
    _kit("sophos", "Sophos Central", "endpoint_id*3 endpoint_type*4 core_remedy_items*4 customer_id*2 source_info.ip*3", ip="source_info.ip", host="location dhost", user="source suser", opaque="endpoint_id customer_id id", text="name", keep="severity type group endpoint_type"),
    _kit("splunk_cim", "Splunk CIM", "sourcetype*3 index*2 splunk_server*4 _time*2 _raw*3 src dest", ip="src_ip dest_ip", host="src dest host dvc splunk_server", user="user src_user", text="_raw", keep="sourcetype index _time action signature"),
    _kit("trend_vision_one", "Trend Vision One", "endpointhostname*3 endpointguid*4 objectcmd*3 processcmd*3 filterriskLevel*2 workbenchid*4 indicators*2 endpointip", ip="endpointip src dst peerip", host="endpointhostname shost dhost", user="logonuser processuser objectuser", opaque="endpointguid workbenchid uuid", text="objectcmd processcmd parentcmd objectfilepath processfilepath request", keep="eventid eventsubid severity"),
    _kit("wazuh", "Wazuh", "rule.id*2 rule.level*2 rule.groups*3 agent.name decoder.name*4 manager.name*4 full_log*4 syscheck.path", ip="agent.ip data.srcip data.dstip", host="agent.name manager.name predecoder.hostname", user="data.srcuser data.dstuser data.win.eventdata.targetusername", text="full_log data.win.system.message syscheck.path", keep="rule.id rule.level rule.description rule.groups decoder.name agent.id"),
    _kit("zscaler", "Zscaler", "clientpublicip*3 serverip*2 urlcategory*3 devicehostname devicewoner*3 deviceowner*3 urlsupercategory*4 reqsize", ip="clientpublicip serverip clientip", host="devicehostname", user="deviceowner login", email="user", text="url refererurl", keep="urlcategory urlsupercategory action reqsize respsize"),
)
KITS: dict[str, Kit] = {k.id: k for k in _ALL}

NESTED = re.compile(r"\([^)]*[+*][^)]*\)[+*{]")


def problems(doc: dict) -> list[str]:
    """What is wrong with a kit document."""
    out = [] if re.fullmatch(r"[a-z0-9_]{2,40}", str(doc.get("id", ""))) else ["bad id"]
    for i, rule in enumerate(doc.get("rules", [])):
        pattern = str(rule.get("pattern", ""))
        try:
            re.compile(pattern)
            bad = not pattern or len(pattern) > 4000 or NESTED.search(pattern)
        except re.error:
            bad = True
        if bad or rule.get("action") not in ("mask", "text", "keep", "drop", "redact"):
            out.append(f"bad rule {i}")
    return out


def load(folder: str | Path, kits: dict[str, Kit] = KITS) -> dict[str, Kit]:
    """``kits`` with those of the folder's JSON files; an invalid file is an error, and so is an alias
    that two kits share."""
    out = dict(kits)
    for path in sorted(Path(folder).glob("*.json")):
        doc = json.loads(path.read_text())
        if wrong := problems(doc):
            raise ValueError(f"{path.name}: {', '.join(wrong)}")
        new = Kit(doc["id"], doc.get("label", doc["id"]), {k.lower(): float(v) for k, v in doc.get("fingerprints", {}).items()}, tuple((r["pattern"], r["action"], r.get("kind")) for r in doc.get("rules", [])), tuple(doc.get("aliases", ())))
        old = out.get(new.id)
        if old and doc.get("mode", "extend") == "extend":
            new = Kit(old.id, new.label, old.fingerprints | new.fingerprints, new.rules + old.rules, old.aliases + new.aliases)
        out[new.id] = new
    names = [a for k in out.values() for a in k.aliases]
    if len(set(names)) < len(names):
        raise ValueError("an alias belongs to two kits")
    return out
