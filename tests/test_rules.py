"""One matching event of each named event, and its whole way to typed fields."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.plans import rules
from logloom.schema import conform

NOW = datetime(2026, 2, 20, 12, 34, 56)
SUBJECT = "Something happened."
MOVED = "A directory service object was moved."
ACTOR = {"SubjectUserName": "adm", "SubjectDomainName": "D"}
TARGET = {"TargetUserName": "obj", "TargetDomainName": "D"}
AUDITING = "Microsoft-Windows-Security-Auditing"
DIRECTORY = {"ObjectDN": "cn=now", "OldObjectDN": "cn=old", "NewObjectDN": "cn=new", "AttributeLDAPDisplayName": "mail", "AttributeValue": "a@b", "OperationType": "%%14674"}
CHANGED = {"OperationType": "Value Added", "FieldChanged": "mail", "FieldValue": "a@b"}
CLOCK = {"NoNameA1": "2/3/2024", "NoNameA0": "4:05:06 PM"}
CLOCKED = datetime(2024, 2, 3, 16, 5, 6)
LOGON = {**TARGET, "LogonType": "3", "ImpersonationLevel": "%%1833", "VirtualAccount": "%%1843", "ElevatedToken": "%%1842", "IpAddress": "10.0.0.1", "IpPort": "5", "LogonProcessName": " User32 "}
LOGGED_ON = {"LogonType": "Network", "ImpersonationLevel": "Impersonation", "VirtualAccount": "Yes", "ElevatedToken": "Yes", "ObjectAffected": "D\\obj", "IpAddress": "10.0.0.1", "IpPort": "5", "LogonProcessName": "User32"}


def case(event_id, data, want, message=SUBJECT, provider="x"):
    return event_id, provider, message, data, want


CASES = {
    "AADConnectRunProfile": case(906, {"Connector Name": "c", "RunProfileName": "Full", "Run Profile Name": "Import"}, {"Connector": "c", "RunProfile": "Full\\Import"}),
    "ADComputerChangeDetailed": case(5136, {**DIRECTORY, "ObjectClass": "Computer"}, {"ComputerObject": "cn=now", **CHANGED}),
    "ADComputerCreateChange": case(4742, {**TARGET, "NewUacValue": "0x202", "DnsHostName": "pc.d"}, {"ComputerAffected": "D\\obj", "NewUacValue": "ACCOUNTDISABLE, NORMAL_ACCOUNT", "OldUacValue": "", "DnsHostName": "pc.d"}),
    "ADComputerDeleted": case(4743, TARGET, {"ComputerAffected": "D\\obj"}),
    "ADGroupPolicyChanges": case(5141, {**DIRECTORY, "ObjectClass": "container"}, {"ObjectClass": "container", "GpoName": "cn=now", "AttributeValue": "a@b"}),
    "ADGroupPolicyChangesDetailed": case(5139, {**DIRECTORY, "ObjectClass": "groupPolicyContainer"}, {"OperationType": "Value Added", "GpoName": "cn=now"}),
    "ADGroupPolicyEdits": case(5136, {**DIRECTORY, "ObjectClass": "groupPolicyContainer", "AttributeLDAPDisplayName": "VERSIONNUMBER"}, {"GroupPolicyDisplayName": "cn=now", "OperationType": "Value Added"}),
    "ADGroupPolicyLinks": case(5136, {**DIRECTORY, "ObjectClass": "site", "AttributeLDAPDisplayName": "gPLink", "DSName": "d.x", "AttributeValue": "[LDAP://cn={AB},dc=x;0][LDAP://cn={CD},dc=x;1]"}, {"Action": "Group policy link added", "LinkedToType": "site", "LinkedTo": "cn=now", "DomainName": "d.x", "GroupPolicies": [("cn={AB},dc=x", True, "AB"), ("cn={CD},dc=x", False, "CD")]}),
    "GpoCreated": case(5137, {**DIRECTORY, "ObjectClass": "groupPolicyContainer"}, {"GpoName": "cn=now"}),
    "GpoDeleted": case(5141, {**DIRECTORY, "ObjectClass": "groupPolicyContainer"}, {"GpoName": "cn=now"}),
    "GpoModified": case(5136, {**DIRECTORY, "ObjectClass": "groupPolicyContainer"}, {"GpoName": "cn=now", "AttributeLDAPDisplayName": "mail", "AttributeValue": "a@b"}),
    "ADGroupChange": case(4764, {**TARGET, "GroupTypeChange": "g", "SamAccountName": "s"}, {"GroupName": "D\\obj", "GroupTypeChange": "g", "SamAccountName": "s"}),
    "ADGroupChangeDetailed": case(5136, {**DIRECTORY, "ObjectClass": "group"}, {"Group": "cn=old", **CHANGED, "FieldValue": "cn=new"}, MOVED),
    "ADGroupCreateDelete": case(4730, TARGET, {"GroupName": "D\\obj"}),
    "ADGroupEnumeration": case(4799, TARGET, {"GroupName": "D\\obj"}),
    "ADGroupMembershipChange": case(4728, {**TARGET, "MemberName": "CN=Jane Doe,OU=x"}, {"GroupName": "D\\obj", "MemberName": "Jane Doe"}),
    "ADLdapBindingDetails": case(2889, {"NoNameA0": "[::1]:389", "NoNameA1": "D\\u", "NoNameA2": "1"}, {"RemoteEndpoint": "[::1]:389", "RemoteIp": "::1", "RemotePort": "389", "AccountName": "D\\u", "BindType": "Simple"}),
    "ADLdapBindingSummary": case(2887, {"NoNameA0": " 7 ", "NoNameA1": "x"}, {"NumberOfSimpleBinds": 7, "NumberOfUnsignedBinds": None}),
    "ADOrganizationalUnitChangeDetailed": case(5139, {**DIRECTORY, "ObjectClass": "organizationalUnit"}, {"OrganizationalUnit": "cn=old", "OperationType": "Moved", "FieldValue": "cn=new", "FieldChanged": "mail"}, MOVED),
    "ADOtherChangeDetailed": case(5136, {**DIRECTORY, "ObjectClass": "printQueue"}, {"User": "cn=now", "ObjectClass": "printQueue", **CHANGED}),
    "AADConnectPasswordSyncFailed": case(611, {"ErrorCode": "8453"}, {"User": "jane", "Error": "8453"}, "Password sync failed for user: jane"),
    "ADSMBServerAuditV1": case(3000, {"ClientName": "10.0.0.9"}, {"ClientAddress": "10.0.0.9"}, provider="microsoft-windows-smbserver"),
    "ADUserChangeDetailed": case(5136, {**DIRECTORY, "ObjectClass": "user", "OperationType": "%%1"}, {"User": "cn=old", **CHANGED, "OperationType": "Unknown Operation", "FieldValue": "cn=new"}, MOVED),
    "ADUserCreateChange": case(4720, {**TARGET, "UserAccountControl": "0x10", "HomePath": "h"}, {"UserAffected": "D\\obj", "UserAccountControl": "LOCKOUT", "HomePath": "h"}),
    "ADUserLockouts": case(4740, {**TARGET, "CallerComputerName": " pc "}, {"UserAffected": "D\\obj", "CallerComputerName": "pc", "ComputerLockoutOn": "pc"}),
    "ADUserLogon": case(4624, LOGON, LOGGED_ON),
    "ADUserLogonFailed": case(4625, {**TARGET, "WorkstationName": "ws", "LogonType": "10", "Status": "0xC000006D", "SubStatus": "0xC0000072", "FailureReason": "%%2304"}, {"Who": "ws", "ObjectAffected": "D\\obj", "LogonType": "RemoteInteractive", "Status": "StatusLogonFailure", "SubStatus": "StatusAccountDisabled", "FailureReason": "UnknownUserNameOrBadPassword"}),
    "ADUserLogonNTLMv1": case(4624, {**LOGON, "LmPackageName": "NTLM V1", "KeyLength": "128", "AuthenticationPackageName": "NTLM"}, {**LOGGED_ON, "LmPackageName": "NTLM V1", "KeyLength": "128", "PackageName": "NTLM"}),
    "ADUserPrivilegeUse": case(4672, {"PrivilegeList": "SeBackupPrivilege \n SeMine"}, {"Privileges": ["SeBackupPrivilege", "SeMine"], "PrivilegesTranslated": ["Back up files and directories", "SeMine"]}),
    "ADUserRightsAssignment": case(4704, {"TargetSid": "S-1-5-32", "PrivilegeList": "SeTcbPrivilege"}, {"UserAffected": "S-1-5-32", "Rights": ["SeTcbPrivilege"], "RightsTranslated": ["Act as part of the operating system"]}),
    "ADUserStatus": case(4725, TARGET, {"UserAffected": "D\\obj"}),
    "ADUserUnlocked": case(4767, TARGET, {"UserAffected": "D\\obj", "ComputerLockoutOn": "D"}),
    "AADConnectStagingDisabled": case(351, {}, {"Operator": "D\\adm"}),
    "AADConnectStagingEnabled": case(350, {"Operator": "op"}, {"Operator": "op"}),
    "AADSyncCycleStage": case(904, {"NoNameA0": "Starting delta cycle. Connector: contoso.com\nTrackingId: abc-1"}, {"Stage": "Start", "Connector": "contoso.com", "TrackingId": "abc-1", "CycleType": "Delta"}, provider="Directory Synchronization"),
    "AADSyncFilterStatus": case(6952, {}, {"Enabled": True, "Connector": "contoso.com"}, "Filtering is Enabled on connector contoso.com", "ADSync"),
    "AADSyncImportStatus": case(133, {}, {"Phase": "Watermark", "TrackingId": "t-1", "SessionId": "s-2", "WatermarkHash": "w3", "PartitionName": "DC=x"}, "Import TrackingId: t-1 SessionId: s-2 Watermark: w3 PartitionName: DC=x", "Directory Synchronization"),
    "AADSyncPasswordHashSyncStatus": case(663, {}, {"PartitionName": "p-1", "ConnectorId": "c-1"}, '<connector id="1">c-1</connector><partition>p-1</partition>', "Directory Synchronization"),
    "CertificateIssued": case(4887, {"CertificateTemplate": "574542", "RequestSubjectName": "jane", "SerialNumber": "0a1"}, {"CertificateTemplate": "WEB", "Requester": "jane", "SerialNumber": "0a1"}),
    "DhcpLeaseCreated": case(10, {"ClientIp": "10.0.0.5", "HwAddress": "aa", "MacAddress": "bb"}, {"IPAddress": "10.0.0.5", "MacAddress": "aa\\bb"}, provider="Microsoft-Windows-DHCP-Server"),
    "ExchangeDatabaseMounted": case(9526, {}, {"MailboxDatabase": "DB01"}, 'The database "DB01" was mounted.'),
    "HyperVVirtualMachineStarted": case(18500, {"VMName": "vm", "VMId": "1"}, {"VirtualMachine": "vm", "VirtualMachineId": "1"}),
    "HyperVCheckpointCreated": case(4096, {"Name": "vm", "SnapshotName": "snap"}, {"VmName": "vm", "CheckpointName": "snap", "User": "adm"}),
    "HyperVVirtualMachineShutdown": case(18560, {"VMName": "vm", "User": "u"}, {"VmName": "vm", "User": "u"}),
    "IISSiteBindingFailure": case(1007, {}, {"SiteName": "Default Web", "Binding": "http/*:80:"}, 'The site "Default Web" failed: binding "http/*:80:" is in use'),
    "IISSiteStopped": case(1005, {}, {"SiteName": SUBJECT, "User": "D\\adm"}),
    "KerberosPolicyChange": case(4713, {"KerberosPolicyChange": "KerMaxT: 0x53d1ac1000 (0x0); KerOpts: 0x80 ;"}, {"PolicyChanges": {"KerMaxT": 10.0, "KerOpts": 1.0}}),
    "KerberosServiceTicket": case(4769, {**TARGET, "ServiceName": "svc", "TicketOptions": "0x40810000", "TicketEncryptionType": "0x17"}, {"AccountName": "D\\obj", "ServiceName": "svc", "EncryptionType": "RC4_HMAC", "WeakEncryptionAlgorithm": True, "UnusualTicketOptions": True}, provider=AUDITING),
    "KerberosTGTRequest": case(4768, {**TARGET, "IpAddress": "::ffff:10.0.0.7", "TicketOptions": "0x40810010", "Status": "0x6", "TicketEncryptionType": "0x12", "PreAuthType": "2"}, {"IpAddress": "10.0.0.7", "StatusText": "KdcErrCPrincipalUnknown (0x00000006)", "PreAuthTypeText": "Password / ENC-TIMESTAMP (2)", "TicketEncryptionTypeText": "AES256_CTS_HMAC_SHA1_96 (0x12)", "WeakEncryptionAlgorithm": False}, provider=AUDITING),
    "KerberosTicketFailure": case(4771, {**TARGET, "Status": "0x18", "TicketEncryptionType": "0x3"}, {"AccountName": "D\\obj", "FailureCode": "0x18", "EncryptionType": "DES_CBC_MD5", "WeakEncryptionAlgorithm": True}, provider=AUDITING),
    "LogsClearedOther": case(104, {"Channel": "System"}, {"BackupPath": "N/A", "LogType": "Unknown Operation"}, provider="Microsoft-Windows-Eventlog"),
    "LogsClearedSecurity": case(1105, {"BackupPath": "c:\\b"}, {"Who": "Automatic Backup", "BackupPath": "c:\\b", "LogType": "Unknown Operation"}, provider="EventLog"),
    "LogsFullSecurity": case(1104, {}, {"LogType": "Unknown Operation"}),
    "NetworkAccessAuthenticationPolicy": case(6273, {**ACTOR, "NASPortType": "19", "AuthenticationType": "eap", "ClientName": "ap", "ProxyPolicyName": "p", "FullyQualifiedSubjectUserName": "D\\full", "ReasonCode": "16"}, {"AccountName": "adm", "NASPortType": "WirelessIEEE80211", "AuthenticationType": "EAP", "ClientFriendlyName": "ap", "ConnectionRequestPolicyName": "p", "Who": "D\\full", "ReasonCode": "16"}),
    "SqlDatabaseCreated": case(1802, {}, {"DatabaseName": "Sales"}, "Starting up database 'Sales'."),
    "AuditPolicyChange": case(4719, {"CategoryId": "%%8", "SubcategoryGuid": "g", "AuditPolicyChanges": "%%1"}, {"CategoryId": "%%8", "SubcategoryGuid": "g", "AuditPolicyChanges": "%%1"}),
    "BitLockerKeyChange": case(4673, {"VolumeName": "%%810", "KeyProtection": "%%2200", "MasterKeyId": "m"}, {"Volume": "OperatingSystemVolume", "ProtectorType": "Tpm", "MasterKeyId": "m"}),
    "BitLockerSuspended": case(24660, {"Volume": "812"}, {"Volume": "RemovableDataVolume"}),
    "ClientGroupPoliciesApplication": case(4098, {"NoNameA0": "user", "NoNameA1": "item", "NoNameA2": "policy", "ErrorDescription": "denied"}, {"PolicyScope": "user", "ItemName": "item", "PolicyName": "policy", "Error": "denied", "ActionTimestampUtc": NOW}, provider="Microsoft-Windows-GroupPolicy"),
    "ClientGroupPoliciesSystem": case(1085, {"NoNameA2": "a", "ExtensionName": "b"}, {"PolicyName": "a\\b", "Error": ""}, provider="Microsoft-Windows-GroupPolicy"),
    "DeviceDisabled": case(6420, {"DeviceDescription": "disk", "Reason": "r"}, {"DeviceName": "disk", "Reason": "r"}),
    "DeviceRecognized": case(6416, {"ClassName": "DiskDrive", "VendorIds": "USB\\VID_0781&PID_1"}, {"DeviceType": "Disk Drive", "Vendor": "SanDisk"}),
    "DfsReplicationError": case(5002, {"Replication Group": "g", "Error": "5", "Partner Name": "p"}, {"ReplicationGroup": "g", "ErrorCode": "5", "Partner": "p"}),
    "FirewallRuleChange": case(4947, {"RuleName": "r", "ProfileChanged": "All"}, {"RuleName": "r", "ProfileChanged": "All"}, provider=AUDITING),
    "NetworkMonitorDriverLoaded": case(7045, {"ServiceName": "npcap"}, {"Driver": "npcap"}, "The Npcap service was installed.", "Service Control Manager"),
    "NetworkPromiscuousMode": case(10400, {"AdapterName": "eth0"}, {"Adapter": "eth0"}, provider="Ndis"),
    "OSBugCheck": case(1001, {"param1": "0x9f", "BugcheckParameter1": "1", "param2": "2", "DumpFile": "f"}, {"BugCheckCode": "0x9f", "Parameter1": "1\\2", "Parameter2": "", "DumpFile": "f"}),
    "OSCrash": case(6008, CLOCK, {"Action": "System crash", "When": CLOCKED}, provider="EventLog"),
    "OSCrashOnAuditFailRecovery": case(4621, {"StartTime": "2026-01-02T03:04:05Z"}, {"Action": "Administrator recovered system from CrashOnAuditFail", "When": datetime(2026, 1, 2, 3, 4, 5)}, provider=AUDITING),
    "OSShutdown": case(13, {}, {"Action": "System shutdown"}, provider="Microsoft-Windows-Kernel-General"),
    "OSStartup": case(12, CLOCK, {"Action": "System start", "When": CLOCKED}, provider="Microsoft-Windows-Kernel-General"),
    "OSStartupSecurity": case(4608, {}, {"Action": "System start"}),
    "OSTimeChange": case(4616, {"PreviousTime": "a", "NewTime": "b"}, {"PreviousTime": "a", "NewTime": "b"}),
    "OSUncleanShutdown": case(41, {}, {"Action": "System restarted without a clean shutdown"}, provider="Microsoft-Windows-Kernel-Power"),
    "ObjectDeletion": case(4660, {"ObjectName": "c:\\f"}, {"Path": "c:\\f"}),
    "ScheduledTaskCreated": case(4698, {"TaskName": "\\t", "TaskContent": "<Task><RegistrationInfo><Date>2026-01-02T03:04:05</Date><Author>D\\adm</Author></RegistrationInfo></Task>"}, {"TaskName": "\\t", "Author": "D\\adm", "Created": datetime(2026, 1, 2, 3, 4, 5)}),
    "ScheduledTaskDeleted": case(4699, {"TaskName": "\\t"}, {"TaskName": "\\t"}),
    "SyncCompleted": case(907, {}, {"Statistics": {"Adds": 3, "Deletes": 4}}, "Adds: 3 Deletes: 4"),
    "WindowsUpdateFailure": case(20, {"UpdateTitle": "Update (KB5001234)", "ErrorDescription": "0x80070005"}, {"KB": "KB5001234", "Reason": "0x80070005"}, provider="Microsoft-Windows-WindowsUpdateClient"),
}
NAMES = sorted(CASES)
#: Records of the same event in another log, and of another provider without its data.
OTHER_LOG, BARE = 1000, 2000


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for i, name in enumerate(NAMES):
        event_id, provider, message, data, _ = CASES[name]
        log = rules.RULES[name].channel
        rows.append((i, event_id, log, provider, message, message, "dc1", ACTOR | data))
        rows.append((i + OTHER_LOG, event_id, "Other", provider, message, message, "dc1", ACTOR | data))
        rows.append((i + BARE, event_id, log, "Nobody", SUBJECT, SUBJECT, "dc1", {}))
    made = spark.createDataFrame(rows, "record_id bigint, id int, log_name string, provider_name string, message string, message_subject string, computer_name string, data map<string,string>")
    return conform(made.withColumn("time_created", F.lit(NOW).cast("timestamp_ntz"))).cache()


def plain(value):
    return [tuple(v) if isinstance(v, tuple) else v for v in value] if isinstance(value, list) else value


def test_every_rule_has_a_case():
    assert set(CASES) == set(rules.RULES) and len(CASES) == 79


@pytest.mark.parametrize("name", NAMES)
def test_rule_fields(frame, name):
    i, rule, want = NAMES.index(name), rules.RULES[name], CASES[name][4]
    found = {r.record_id: r for r in rules.project(frame, name).collect()}
    row = found[i].asDict()
    heads = {"Computer": "dc1", "Action": CASES[name][2], "Who": "D\\adm", "When": NOW}
    expected = {k: v for k, v in heads.items() if k in row} | want
    assert {k: plain(row[k]) for k in expected} == expected
    assert not any(OTHER_LOG <= r < BARE for r in found)
    # Only a rule without a condition (or with a mere exclusion) takes an event without data of another provider.
    assert (i + BARE in found) == (rule.predicate is None or name == "ADGroupChange")


def test_dispatch_takes_every_event_once(frame):
    own = frame.where(F.col("record_id") < OTHER_LOG)
    got = {r.record_id: r.named_event for r in rules.classify(own, NAMES).collect()}
    assert len(got) == len(NAMES)
    for i, name in enumerate(NAMES):
        assert got[i] <= name and CASES[name][0] in rules.RULES[got[i]].ids
        assert rules.RULES[name] in rules.handlers(CASES[name][0], rules.RULES[name].channel)
