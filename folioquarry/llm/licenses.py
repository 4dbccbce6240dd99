"""License scans: ordered signature rules behind a keyword prefilter.

A rule is (label, priority, confidence, keywords, pattern); whatever the pattern matches holds one of the keywords. Sentences
of license texts and notices are written out one by one; names, addresses and SPDX ids of families follow templates. A text is folded (ASCII letters only), its keywords are found
in one pass of an automaton, and only the rules of keywords that occur are run. Every detection is an interval of the
text. Where intervals overlap, the higher priority wins: a detection that lies inside one of higher priority, or inside a
longer one of the same priority, is suppressed. Base phrases are counted on words and are never suppressed.

All patterns work on UTF-8 bytes: a byte is part of a word iff it is 0-9, a-z or at least 0x80.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License families: label, keywords, name pattern (_ stands for any run of separators), SPDX ids, address pattern.
FAMILIES = """
agpl | affero | (?:gnu_)?affero_general_public_license | AGPL-3.0 AGPL-1.0 | gnu\\.org/licenses/agpl
lgpl | lesser library | (?:gnu_)?(?:lesser|library)_general_public_license | LGPL-2.1 LGPL-3.0 LGPL-2.0 | gnu\\.org/licenses/lgpl
gfdl | documentation | gnu_free_documentation_license | GFDL-1.3 GFDL-1.2 GFDL-1.1 | gnu\\.org/licenses/fdl
gpl | gnu | gnu_(?:general_public_license|gpl) | GPL-2.0 GPL-3.0 GPL-1.0 | gnu\\.org/licenses/(?:old-licenses/)?gpl
apache | apache | apache_(?:software_)?license | Apache-2.0 Apache-1.1 Apache-1.0 | apache\\.org/licenses
mit | mit expat | (?:mit|expat)_license | MIT MIT-0 X11 | opensource\\.org/licenses/mit
bsd | bsd | (?:new_|simplified_|modified_|original_)?bsd_(?:[0234]_clause_)?license | BSD-3-Clause BSD-2-Clause BSD-4-Clause 0BSD | opensource\\.org/licenses/bsd
isc | isc | isc_license | ISC | opensource\\.org/licenses/isc
mpl | mozilla | mozilla_public_license | MPL-2.0 MPL-1.1 MPL-1.0 | mozilla\\.org/(?:en-us/)?mpl
epl | eclipse | eclipse_public_license | EPL-2.0 EPL-1.0 | eclipse\\.org/legal/epl
edl | eclipse | eclipse_distribution_license | EDL-1.0 | eclipse\\.org/org/documents/edl
cddl | common | common_development_and_distribution_license | CDDL-1.0 CDDL-1.1 | opensource\\.org/licenses/cddl
cpl | common | common_public_license | CPL-1.0 | opensource\\.org/licenses/cpl
eupl | european | european_union_public_licen[cs]e | EUPL-1.2 EUPL-1.1 | joinup\\.ec\\.europa\\.eu
artistic | artistic | (?:perl_)?artistic_license | Artistic-2.0 Artistic-1.0 | perlfoundation\\.org/artistic
bsl | boost | boost_software_license | BSL-1.0 | boost\\.org/license
zlib | zlib | zlib(?:_libpng)?_license | Zlib | zlib\\.net/zlib_license
unlicense | unlicense | the_unlicense | Unlicense | unlicense\\.org
wtfpl | what | do_what_the_fuck_you_want_to_public_license | WTFPL | wtfpl\\.net
cc0 | cc0 | cc0(?:_1_0)?(?:_universal)? | CC0-1.0 | creativecommons\\.org/publicdomain/zero
cc-by-nc-nd | cc | cc_by_nc_nd | CC-BY-NC-ND-4.0 CC-BY-NC-ND-3.0 | creativecommons\\.org/licenses/by-nc-nd
cc-by-nc-sa | cc | cc_by_nc_sa | CC-BY-NC-SA-4.0 CC-BY-NC-SA-3.0 | creativecommons\\.org/licenses/by-nc-sa
cc-by-nc | cc | cc_by_nc | CC-BY-NC-4.0 CC-BY-NC-3.0 CC-BY-NC-2.0 | creativecommons\\.org/licenses/by-nc/
cc-by-nd | cc | cc_by_nd | CC-BY-ND-4.0 CC-BY-ND-3.0 | creativecommons\\.org/licenses/by-nd
cc-by-sa | cc | cc_by_sa | CC-BY-SA-4.0 CC-BY-SA-3.0 | creativecommons\\.org/licenses/by-sa
cc-by | creative | creative_commons_attribution | CC-BY-4.0 CC-BY-3.0 CC-BY-2.0 | creativecommons\\.org/licenses/by/
odbl | open | open_database_license | ODbL-1.0 | opendatacommons\\.org/licenses/odbl
pddl | public | public_domain_dedication_and_license | PDDL-1.0 | opendatacommons\\.org/licenses/pddl
odc-by | open | open_data_commons_attribution_license | ODC-By-1.0 | opendatacommons\\.org/licenses/by
ofl | sil | sil_open_font_license | OFL-1.1 OFL-1.0 | scripts\\.sil\\.org/ofl
psf | python | python_software_foundation_license | PSF-2.0 Python-2.0 | docs\\.python\\.org/license
php | php | php_license | PHP-3.01 PHP-3.0 | php\\.net/license
ruby | ruby | ruby_license | Ruby | ruby-lang\\.org/license
postgresql | postgresql | postgresql_license | PostgreSQL | postgresql\\.org/about/licen[cs]e
openssl | openssl | openssl_license | OpenSSL | openssl\\.org/source/license
ncsa | ncsa | (?:university_of_illinois_)?ncsa_open_source_license | NCSA | opensource\\.org/licenses/ncsa
upl | universal | universal_permissive_license | UPL-1.0 | oss\\.oracle\\.com/licenses/upl
ms-pl | microsoft | microsoft_public_license | MS-PL | opensource\\.org/licenses/ms-pl
ms-rl | microsoft | microsoft_reciprocal_license | MS-RL | opensource\\.org/licenses/ms-rl
osl | open | open_software_license | OSL-3.0 OSL-2.1 | opensource\\.org/licenses/osl
afl | academic | academic_free_license | AFL-3.0 AFL-2.1 | opensource\\.org/licenses/afl
qpl | q | q_public_license | QPL-1.0 | opensource\\.org/licenses/qtpl
bsl-1.1 | business | business_source_license | BUSL-1.1 | mariadb\\.com/bsl
sspl | server | server_side_public_license | SSPL-1.0 | mongodb\\.com/licensing/server-side
elastic | elastic | elastic_license | Elastic-2.0 | elastic\\.co/licensing/elastic-license
public-domain | public | public_domain | LicenseRef-Public-Domain | creativecommons\\.org/publicdomain/mark
"""

# Signature templates over a family: priority, confidence, pattern ({n} name, {u} address, {s} SPDX id).
NAME_RULES = (
    (90, 0.98, r"(?:licen[cs]ed|released|distributed|available|published|provided)_(?:under|with|by)_(?:the_)?(?:terms_of_(?:the_)?)?{n}(?:_v(?:ersion)?)?(?:_[0-9]+(?:_[0-9]+)*)?"),
    (95, 0.98, r"(?:this|the)_(?:work|file|software|program|document|text|content|library|project)_(?:is|are)_licen[cs]ed_under_(?:the_)?{n}(?:_v(?:ersion)?)?(?:_[0-9]+(?:_[0-9]+)*)?"),
    (70, 0.9, r"{n}_v(?:ersion)?_?[0-9]+(?:_[0-9]+)*(?:_or_(?:any_)?later)?"),
    (60, 0.85, r"(?:subject|according|pursuant)_to_(?:the_)?(?:terms_of_(?:the_)?)?{n}"),
    (40, 0.6, r"{n}"),
)
# Families whose bare name is no sign of a license.
NEEDS_CONTEXT = ("public-domain",)
ADDRESS_RULE = (80, 0.95, r"(?:https?://)?(?:www\.)?{u}[^\s<>\x22]*")
SPDX_RULE = (100, 1.0, r"spdx-license-identifier:[ \t]*\(?{s}(?:-only|-or-later|\+)?(?![0-9a-z\x80-\xff.-])")

# Sentences of license texts and of the notices that grant them: label, keyword, pattern (_ as above).
SIGNATURES = """
mit | granted | permission_is_hereby_granted_free_of_charge_to_any_person_obtaining_a_copy_of_this_software_and_associated_documentation_files
mit | sublicense | to_use_copy_modify_merge_publish_distribute_sublicense_and_or_sell_copies_of_the_software
mit | permission | the_above_copyright_notice_and_this_permission_notice_shall_be_included_in_all_copies_or_substantial_portions_of_the_software
mit | noninfringement | merchantability_fitness_for_a_particular_purpose_and_noninfringement
mit | dealings | arising_from_out_of_or_in_connection_with_the_software_or_the_use_or_other_dealings_in_the_software
mit-0 | granted | permission_is_hereby_granted_free_of_charge_to_any_person_obtaining_a_copy_of_this_software_and_associated_documentation_files_to_deal_in_the_software_without_restriction_(?:.{0,300}?)sell_copies_of_the_software_and_to_permit_persons_to_whom_the_software_is_furnished_to_do_so_the_software_is_provided
x11 | consortium | except_as_contained_in_this_notice_the_name_of_the_x_consortium_shall_not_be_used_in_advertising
hpnd | permission | permission_to_use_copy_modify_and_distribute_this_software_and_its_documentation_for_any_purpose(?:_and)?_without_fee_is_hereby_granted
hpnd | advertising | not_be_used_in_advertising_or_publicity_pertaining_to_distribution_of_the_software
isc | permission | permission_to_use_copy_modify_and(?:_or)?_distribute_this_software_for_any_purpose_with_or_without_fee_is_hereby_granted
isc | disclaims | the_author_disclaims_all_warranties_with_regard_to_this_software
0bsd | permission | permission_to_use_copy_modify_and_or_distribute_this_software_for_any_purpose_with_or_without_fee_is_hereby_granted_the_software_is_provided
bsd | redistribution | redistribution_and_use_in_source_and_binary_forms_with_or_without_modification_are_permitted
bsd | redistributions | redistributions_of_source_code_must_retain_the_above_copyright_notice
bsd | redistributions | redistributions_in_binary_form_must_reproduce_the_above_copyright_notice
bsd | endorse | (?:neither_the_names?_of_|the_names?_of_).{1,120}?_(?:nor_the_names_of_its_contributors_)?may(?:_not)?_be_used_to_endorse_or_promote_products_derived_from_this_software
bsd | contributors | this_software_is_provided_by_the_(?:copyright_holders|regents|authors?)_and_contributors_as_is
bsd-4 | advertising | all_advertising_materials_mentioning_features_or_use_of_this_software_must_display_the_following_acknowledge?ment
bsd | berkeley | (?:licensed|released|distributed)_under_the_(?:terms_of_the_)?berkeley_software_distribution_licen[cs]e
apache | limitations | see_the_license_for_the_specific_language_governing_permissions_and_limitations_under_the_license
apache | apache | you_may_obtain_a_copy_of_the_license_at_https?_www_apache_org
apache | apache | licensed_to_the_apache_software_foundation_asf_under_one_or_more_contributor_license_agreements
apache | compliance | you_may_not_use_this_file_except_in_compliance_with_the_license
apache | distributed | unless_required_by_applicable_law_or_agreed_to_in_writing_software_distributed_under_the_license_is_distributed_on_an_as_is_basis
apache | reproduction | terms_and_conditions_for_use_reproduction_and_distribution
apache | perpetual | each_contributor_hereby_grants_to_you_a_perpetual_worldwide_non_exclusive_no_charge_royalty_free_irrevocable_(?:copyright|patent)_license
apache | apache | this_product_includes_software_developed_(?:by_the_apache_software_foundation|at_the_apache_software_foundation)
apache | apache | alv2_licen[cs]e_apache|apache_2_0_licen[cs]ed?
gpl | redistribute | you_can_redistribute_it_and_or_modify_it_under_the_terms_of_the_gnu_general_public_license
gpl | gnu | you_should_have_received_a_copy_of_the_gnu_general_public_license
gpl | gnu | see_the_gnu_general_public_license_for_more_details
gpl | changing | everyone_is_permitted_to_copy_and_distribute_verbatim_copies_of_this_license_document_but_changing_it_is_not_allowed
gpl | designed | the_licenses_for_most_software_(?:and_other_practical_works_)?are_designed_to_take_away_your_freedom
gpl | later | either_version_[123]_of_the_license_or_at_your_option_any_later_version
gpl | welcome | this_is_free_software_and_you_are_welcome_to_redistribute_it_under_certain_conditions
gpl | gpl | gpl_?v?[123](?:_0)?_or_later|gpl_?v?[123](?:_0)?_only|gnu_gpl(?:_v(?:ersion)?)?_?[123]
lgpl | lesser | you_should_have_received_a_copy_of_the_gnu_lesser_general_public_license
lgpl | library | you_should_have_received_a_copy_of_the_gnu_library_general_public_license
lgpl | lesser | under_the_terms_of_the_gnu_lesser_general_public_license
lgpl | library | under_the_terms_of_the_gnu_library_general_public_license
lgpl | combined | this_version_of_the_gnu_lesser_general_public_license_incorporates_the_terms_(?:.{0,80}?)combined|a_combined_work_is_a_work_produced_by_combining_or_linking_an_application_with_the_library
agpl | affero | you_should_have_received_a_copy_of_the_gnu_affero_general_public_license
agpl | affero | under_the_terms_of_the_gnu_affero_general_public_license
agpl | remotely | your_modified_version_must_prominently_offer_all_users_interacting_with_it_remotely_through_a_computer_network
gfdl | invariant | permission_is_granted_to_copy_distribute_and_or_modify_this_document_under_the_terms_of_the_gnu_free_documentation_license(?:.{0,200}?)invariant
gfdl | invariant | with_no_invariant_sections_(?:with_)?no_front_cover_texts_and_(?:with_)?no_back_cover_texts
mpl | mozilla | this_source_code_form_is_subject_to_the_terms_of_the_mozilla_public_license
mpl | mpl | if_a_copy_of_the_mpl_was_not_distributed_with_this_file
mpl | mozilla | the_contents_of_this_file_are_subject_to_the_mozilla_public_license
mpl | secondary | this_source_code_form_is_incompatible_with_secondary_licenses
epl | eclipse | this_program_and_the_accompanying_materials_are_made_available_under_the_terms_of_the_eclipse_public_license
epl | agreement | any_use_reproduction_or_distribution_of_the_program_constitutes_recipient_s_acceptance_of_this_agreement
edl | eclipse | made_available_under_the_terms_of_the_eclipse_distribution_license
cddl | cddl | subject_to_the_terms_of_the_common_development_and_distribution_license_(?:.{0,40}?)cddl|cddl_(?:header_start|header_end)
cddl | development | the_contents_of_this_file_are_subject_to_the_terms_of_the_common_development_and_distribution_license
cpl | common | made_available_under_the_terms_of_the_common_public_license
eupl | eupl | licensed_under_the_eupl|this_european_union_public_licence_the_eupl
artistic | artistic | the_intent_of_this_document_is_to_state_the_conditions_under_which_a_package_may_be_copied_(?:.{0,200}?)artistic
artistic | perl | you_can_redistribute_it_and_or_modify_it_under_the_same_terms_as_perl(?:_itself)?
artistic | artistic | terms_of_the_artistic_license
bsl | boost | distributed_under_the_boost_software_license
bsl | obtaining | permission_is_hereby_granted_free_of_charge_to_any_person_or_organization_obtaining_a_copy_of_the_software_and_accompanying_documentation
bsl | object | machine_executable_object_code_generated_by_a_source_language_processor
zlib | misrepresented | the_origin_of_this_software_must_not_be_misrepresented
zlib | altered | altered_source_versions_must_be_plainly_marked_as_such
zlib | express | this_software_is_provided_as_is_without_any_express_or_implied_warranty_in_no_event_will_the_authors_be_held_liable
libpng | libpng | the_png_reference_library_is_supplied_as_is_(?:.{0,200}?)libpng|libpng_versions?_[0-9]
unlicense | unencumbered | this_is_free_and_unencumbered_software_released_into_the_public_domain
unlicense | anyone | anyone_is_free_to_copy_modify_publish_use_compile_sell_or_distribute_this_software
wtfpl | fuck | you_just_do_what_the_fuck_you_want_to
cc0 | waive | to_the_extent_possible_under_law_.{1,120}?_(?:has|have)_waived?_all_copyright
cc0 | affirmer | affirmer_hereby_overtly_fully_permanently_irrevocably_and_unconditionally_waives
cc0 | cc0 | (?:released|published|available|dedicated|licensed)_under_(?:the_)?(?:creative_commons_)?cc0
cc-by-nc-nd | noderivatives | creative_commons_attribution_non_?commercial_noderivatives|attribution_non_?commercial_noderivatives_[1-4]
cc-by-nc-nd | noderivs | creative_commons_attribution_non_?commercial_noderivs|attribution_non_?commercial_noderivs_[1-4]
cc-by-nc-sa | sharealike | creative_commons_attribution_non_?commercial_sharealike|attribution_non_?commercial_sharealike_[1-4]
cc-by-nc-sa | share | creative_commons_attribution_non_?commercial_share_alike
cc-by-nc | commercial | creative_commons_attribution_non_?commercial(?:_[1-4]_[0-9])?_(?:international|unported|generic|licen[cs]e)
cc-by-nd | noderivatives | creative_commons_attribution_noderivatives|attribution_noderivatives_[1-4]
cc-by-nd | noderivs | creative_commons_attribution_noderivs|attribution_noderivs_[1-4]
cc-by-sa | sharealike | creative_commons_attribution_sharealike|attribution_sharealike_[1-4]
cc-by-sa | share | creative_commons_attribution_share_alike
cc-by | attribution | attribution_[1-4]_[0-9]_(?:international|unported|generic)
cc-by | attribution | you_must_give_appropriate_credit_provide_a_link_to_the_license_and_indicate_if_changes_were_made(?:.{0,120}?)attribution
cc-by | licensor | you_must_give_appropriate_credit_provide_a_link_to_the_license_and_indicate_if_changes_were_made(?:.{0,200}?)licensor
cc-by-sa | remix | if_you_remix_transform_or_build_upon_the_material_you_must_distribute_your_contributions_under_the_same_license
cc-by-nc | commercial | you_may_not_use_the_material_for_commercial_purposes
cc-by-nd | remix | if_you_remix_transform_or_build_upon_the_material_you_may_not_distribute_the_modified_material
odbl | database | this_.{1,60}?_is_made_available_under_the_open_database_license
odbl | contents | any_rights_in_individual_contents_of_the_database_are_licensed_under_the_database_contents_license
pddl | dedication | made_available_under_the_public_domain_dedication_and_license
odc-by | attribution | made_available_under_the_open_data_commons_attribution_license
ogl-uk | government | contains_public_sector_information_licensed_under_the_open_government_licen[cs]e
ogl-uk | government | licensed_under_the_open_government_licen[cs]e
ofl | font | this_font_software_is_licensed_under_the_sil_open_font_license
ofl | reserved | no_modified_version_of_the_font_software_may_use_the_reserved_font_name
psf | python | this_license_agreement_is_between_the_python_software_foundation
psf | python | psf_hereby_grants_licensee_(?:.{0,200}?)python
php | php | this_source_file_is_subject_to_version_[0-9]_[0-9]+_of_the_php_license
php | php | this_product_includes_php_software_freely_available_from
ruby | ruby | you_can_redistribute_it_and_or_modify_it_under_either_the_terms_of_the_(?:2_clause_bsdl|gpl)(?:.{0,200}?)ruby|same_terms_as_ruby
postgresql | paragraph | without_a_written_agreement_is_hereby_granted_provided_that_the_above_copyright_notice_and_this_paragraph_and_the_following_two_paragraphs
openssl | openssl | this_product_includes_software_developed_by_the_openssl_project_for_use_in_the_openssl_toolkit
openssl | cryptographic | this_product_includes_cryptographic_software_written_by_eric_young
ncsa | ncsa | university_of_illinois_ncsa_open_source_license
upl | universal | licensed_under_the_universal_permissive_license
upl | larger | to_any_person_obtaining_a_copy_of_this_software_associated_documentation_and_or_data_(?:.{0,300}?)larger_works
ms-pl | microsoft | this_license_governs_use_of_the_accompanying_software_if_you_use_the_software_you_accept_this_license_(?:.{0,400}?)microsoft
ms-rl | reciprocal | reciprocal_grants_for_any_file_you_distribute_that_contains_code_from_the_software
osl | open | licensed_under_the_open_software_license_version
osl | osl | osl_[23]_[0-9]_licen[cs]ed?
afl | academic | licensed_under_the_academic_free_license_version
qpl | public | subject_to_the_terms_of_the_q_public_license
bsl-1.1 | business | the_business_source_license_this_document_or_the_license_is_not_an_open_source_license
bsl-1.1 | change | the_licensor_hereby_grants_you_the_right_to_copy_modify_create_derivative_works_redistribute_and_make_non_production_use_of_the_licensed_work(?:.{0,400}?)change_date
sspl | service | if_you_make_the_functionality_of_the_program_or_a_modified_version_available_to_third_parties_as_a_service
elastic | elastic | licensed_under_the_elastic_license|by_using_the_software_you_agree_to_all_of_the_terms_and_conditions_below_(?:.{0,200}?)elastic
elastic | managed | you_may_not_provide_the_software_to_third_parties_as_a_hosted_or_managed_service
public-domain | public | (?:released|dedicated|placed|put|donated)_(?:in_?to|to|in)_the_public_domain
public-domain | public | (?:work|file|code|software|text|book|image)_is_in_the_public_domain
public-domain | public | public_domain_(?:mark|dedication|work|licen[cs]e)
json | evil | the_software_shall_be_used_for_good_not_evil
beerware | beer | if_we_meet_some_day_and_you_think_this_stuff_is_worth_it_you_can_buy_me_a_beer_in_return
curl | curl | copyright_(?:.{0,80}?)daniel_stenberg(?:.{0,200}?)curl
icu | unicode | permission_is_hereby_granted_free_of_charge_to_any_person_obtaining_a_copy_of_the_unicode_data_files
unicode | unicode | unicode_(?:inc_)?license_agreement_data_files_and_software
w3c | w3c | w3c_software_(?:notice_and_license|and_document_notice_and_license)
vim | vim | there_are_no_restrictions_on_distributing_unmodified_copies_of_vim
ijg | jpeg | this_software_is_based_in_part_on_the_work_of_the_independent_jpeg_group
freetype | freetype | portions_of_this_software_are_copyright_(?:.{0,80}?)freetype_project
ftl | freetype | the_freetype_project_license
info-zip | zip | copyright_and_license_version_(?:.{0,100}?)info_zip
sleepycat | redistributions | redistributions_in_any_form_must_be_accompanied_by_information_on_how_to_obtain_complete_source_code
watcom | watcom | sybase_open_watcom_public_license
nasa | nasa | nasa_open_source_agreement
ecl | educational | licensed_under_the_educational_community_license
cecill | cecill | cecill_free_software_license(?:_agreement)?|governed_by_the_cecill(?:_[abc])?_license
mulan | mulan | licensed_under_(?:the_)?mulan_psl|mulan_permissive_software_license
blueoak | oak | blue_oak_model_license
polyform | polyform | polyform_(?:noncommercial|small_business|shield|strict|internal_use|perimeter)_license
llama | llama | llama_[0-9]+(?:_[0-9]+)?_community_license_agreement
openrail | rail | (?:creativeml|bigscience|bigcode)_open_?rail(?:_[a-z]+)?_license|openrail_?(?:pp|m|s)
all-rights-reserved | reserved | (?:copyright|©|\\(c\\)).{0,120}?_all_rights_reserved
proprietary | proprietary | this_software_is_(?:the_)?(?:confidential_and_)?proprietary_(?:and_confidential_)?(?:information_of|property_of)
proprietary | unauthorized | unauthorized_copying_of_this_file_via_any_medium_is_strictly_prohibited
"""
SIGNATURE = (85, 0.95)

_W = "0-9a-z\x80-\xff"
_CLASS = np.zeros(256, bool)
_CLASS[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
SPANS = "doc_id long, label string, priority int, confidence double, start long, stop long"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


def _words(pattern: str) -> str:
    gap = f"[^{_W}]"
    return rf"(?<![{_W}])(?:{pattern.replace('_?', gap + '*').replace('_', gap + '+')})(?![{_W}])"


def _bytes(pattern: str) -> re.Pattern:
    return re.compile(pattern.encode("latin-1"), re.DOTALL)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; those of one priority in the order of SIGNATURES and FAMILIES."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, keyword, pattern = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, *SIGNATURE, (keyword,), _bytes(_words(pattern))))
    for line in FAMILIES.strip().splitlines():
        label, keywords, name, spdx, address = (x.strip() for x in line.split(" | "))
        out += [Rule(label, p, c, tuple(keywords.split()), _bytes(_words(t.format(n=name)))) for p, c, t in NAME_RULES if t != "{n}" or label not in NEEDS_CONTEXT]
        p, c, t = ADDRESS_RULE
        out.append(Rule(label, p, c, (re.split(r"\\\.|/", address)[0],), _bytes(t.format(u=address))))
        p, c, t = SPDX_RULE
        out += [Rule(label, p, c, ("spdx",), _bytes(t.format(s=re.escape(s.lower())))) for s in spdx.split()]
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def _prefilter():
    import ahocorasick

    by: dict[str, list[int]] = {}
    for k, r in enumerate(rules()):
        for word in r.keywords:
            by.setdefault(word, []).append(k)
    found = ahocorasick.Automaton()
    for word, ks in by.items():
        found.add_word(word, (ks, None))
    for phrase, label in BASE.items():
        word = phrase.split()[0]
        mark = by.get(word, [])
        found.add_word(word, (mark, word))
    found.make_automaton()
    return found


@cache
def _base() -> dict[str, list[tuple[str, re.Pattern]]]:
    out: dict[str, list] = {}
    for phrase, label in BASE.items():
        out.setdefault(phrase.split()[0], []).append((label, _bytes(_words(phrase.replace(" ", "_")))))
    return out


def detect(folded: bytes, chosen: set[int]) -> list[tuple[int, int, int]]:
    """(rule, start, stop) of the detections that stay."""
    every = rules()
    hits = [(every[k].priority, m.start(), m.end(), k) for k in chosen for m in every[k].pattern.finditer(folded)]
    hits.sort(key=lambda h: (-h[0], h[1] - h[2], h[1], h[3]))
    # an earlier interval contains this one if among the starts up to its own some stop reaches its stop: prefix maxima in a tree
    starts = sorted({h[1] for h in hits})
    reach = [-1] * (len(starts) + 1)
    stay: list[tuple[int, int, int]] = []
    for _, start, stop, k in hits:
        at = i = bisect_right(starts, start)
        most = -1
        while i > 0:
            most = max(most, reach[i])
            i -= i & -i
        if most < stop:
            stay.append((k, start, stop))
        while at <= len(starts):
            reach[at] = max(reach[at], stop)
            at += at & -at
    return stay


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int]]]:
    """Number of words; (first word, label) of the base places in order; detections that stay."""
    folded = (text or "").encode("utf-8", "surrogatepass").lower()
    if not folded:
        return 0, [], []
    inside = _CLASS[np.frombuffer(folded, np.uint8)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    n = int(np.count_nonzero(begins))
    chosen: set[int] = set()
    words: set[str] = set()
    for _, (ks, word) in _prefilter().iter(folded.decode("latin-1")):
        chosen.update(ks)
        if word:
            words.add(word)
    if not chosen and not words:
        return n, [], []
    places = [(m.start(), label) for w in words for label, pattern in _base()[w] for m in pattern.finditer(folded)]
    if places:
        at = np.flatnonzero(begins)
        places = sorted((int(np.searchsorted(at, s)), label) for s, label in places)
    return n, places, detect(folded, chosen)


def license_labels(docs: DataFrame) -> DataFrame:
    """Per document the base places and all labels; null texts are empty; texts without a hit have '' and 0.0.

    score is 1 minus the product of (1 - confidence) over the detections that stay (base places count 0.9 each label).
    Repeated rows give repeated results; null ids are kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = rules()
        for b in batches:
            out: list[list] = [[] for _ in NAMES[1:]]
            for text in b.column(1).to_pylist():
                n, places, found = scan(text)
                base = sorted({x for _, x in places})
                both = sorted({*base, *(every[k].label for k, _, _ in found)})
                miss = 0.1 ** len(base)
                for k, _, _ in found:
                    miss *= 1 - every[k].confidence
                row = (n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), ",".join(both), 1 - miss if both else 0.0, len(found))
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def license_spans(docs: DataFrame) -> DataFrame:
    """The detections themselves: doc_id, label, priority, confidence, start and stop in bytes of the UTF-8 text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = rules()
        for b in batches:
            rows = [(i, every[k].label, every[k].priority, every[k].confidence, s, e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, s, e in scan(t)[2]]
            types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "label", "priority", "confidence", "start", "stop"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)
